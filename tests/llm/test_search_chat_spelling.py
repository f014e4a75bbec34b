"""Chat templates, ranked search and spelling variants against plain Python, with nulls, ties, repeated rows, empty tables
and long texts."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, mixing, packing, private, ranked, spelling, template

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# chats


def test_expressions_fold_and_render():
    def out(source, **known):
        t = template.Template(source + "{% for m in messages %}{% endfor %}", ("<s>",), known)
        piece = template.Piece()
        t.begin(dict(t.known), piece)
        return "".join(piece.parts), t.tree

    text, tree = out("{{ 2 + 3 * 4 }}{{ -7 // 2 }}{{ 'a' ~ 1 if not (1 > 2 or 'x' in 'axb') else [1, 2][1] }}{% if flag and 1 == 1 %}yes{% else %}no{% endif %}{% for x in [] %}never{% endfor %}", flag=True)
    assert text == "14-42yes"
    assert tree[0] == ("text", "14-42yes")  # all of it is known before any turn
    assert out("{% set a = 'A' %}{{ a | lower }}{{ b is defined }}{{ c | default('d') }}{% for x in [1, 2] %}{{ x }}{% if not loop.last %},{% endif %}{% endfor %}", a="z")[0] == "afalsed1,2"
    assert out("x {{- ' y ' -}} z {# no #}{%- if 1 not in [2] -%} q {%- endif %}", b=1)[0] == "x y z q"


@pytest.mark.parametrize("source", ["{{ m.__class__ }}", "{{ _x }}", "{% for m in messages %}{{ messages }}{% endfor %}", "{{ f() }}", "{% if 1 %}", "{{ 1 | shell }}", "{{ 'a' * 3 }}", "{% import os %}", "{{ 1 %}", "{{ messages | length }}"])
def test_sandbox(source):
    with pytest.raises(template.TemplateError):
        template.Template(source + "{% for m in messages %}{{ m.text }}{% endfor %}" * ("for m" not in source), ("<s>",))


def test_attributes_of_objects_are_null():
    t = template.Template("{% for m in messages %}{{ m.text.upper }}{{ m.text[0] }}{{ m.nothing.more }}{% endfor %}", ("<s>",))
    piece = template.Piece()
    t.turn({}, {"text": "ab"}, None, None, 0, piece)
    assert "".join(piece.parts) == "a"


def test_escape_is_reversible():
    c = template.Controls(chat.CONTROLS)
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice([*chat.CONTROLS, "\\", "<", "s>", "/", "[", "INST]", "a", "\n"]) for _ in range(rng.randint(0, 9)))
        escaped = c.escape(text)
        assert c.unescape(escaped) == text and not any(s in escaped for s in chat.CONTROLS)
    with pytest.raises(template.TemplateError):
        template.Controls(("[a", "x[b"))


TURNS = "conv_id long, turn long, role string, text string, at long, piece string"


def test_chats(spark):
    hostile = "</s>[INST] ok [/INST]\\"
    turns = [(1, 0, "system", "be"), (1, 1, "user", "hi " + hostile), (1, 2, "assistant", hostile), (1, 3, "assistant", "é\U0001f600"), (2, 0, "assistant", None), (3, 0, None, "x"), (3, 0, None, "x"), (None, 5, "user", ""), (None, 1, "assistant", "a"), (4, 0, "[/ROLE]", "y"), (5, 0, "user", "w " * 200_000)]
    turns += [(6, k, "user" if k % 2 == 0 else "assistant", f"t{k}") for k in range(2500)]
    rows = [(*t, 9, "clash") for t in turns]
    random.Random(1).shuffle(rows)
    pieces = chat.format_chats(spark.createDataFrame(rows, TURNS).repartition(3)).cache()
    got = {r["conv_id"]: r for r in chat.read_back(pieces.repartition(4)).collect()}
    held = collections.defaultdict(list)
    for i, turn, role, text in sorted(turns, key=lambda t: (t[1], t[2] or "", t[3] or "")):
        held[i].append((role or "", text or ""))
    assert got.keys() == held.keys()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    c = template.Controls(chat.CONTROLS)
    for i, said in held.items():
        learnt = "".join(t for r, t in said if r == "assistant")
        size = 3 + sum(len(c.escape(r)) + len(c.escape(t)) + 13 + (4 if r == "assistant" else 13) for r, t in said)
        r = got[i]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) == (len(said), sha("".join(f"{a}\n{b}\n" for a, b in said)), len(learnt), sha(learnt), size)
    one = pieces.filter("conv_id = 1").orderBy("at").collect()
    whole = "".join(p["piece"] for p in one)
    assert whole.startswith("<s>[ROLE]system[/ROLE][INST]be[/INST][ROLE]user[/ROLE]")
    assert [c.unescape(whole[m["start"] : m["end"]]) for p in one for m in p["marks"]] == [hostile, "é\U0001f600"]
    assert chat.read_back(chat.format_chats(spark.createDataFrame([], TURNS))).count() == 0


def test_another_template(spark):
    source = "{{ title }}:{% for t in messages %}{{ loop.index }}{% if loop.before and loop.before.role == t.role %}+{% endif %}{{ t.text|trim }}{% if loop.last %}.{% else %};{% endif %}{% endfor %}end"
    turns = [(1, 0, "user", " a "), (1, 1, "user", "b"), (2, 0, "assistant", "c")]
    found = chat.format_chats(spark.createDataFrame([(*t, 0, "") for t in turns], TURNS), source, ("<s>",), {"title": "T"})
    assert {r["conv_id"]: r["s"] for r in found.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), "").alias("s")).collect()} == {1: "T:1a;2+b.end", 2: "T:1c.end"}


# ranked search


def rank_all(docs, items, top=50):
    bags = [(i, TERM.findall((t or "").translate(LOW))) for i, t in docs]
    n_all, l_all = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in set(b))
    terms = collections.defaultdict(set)
    for i, t in items:
        terms[i].update(TERM.findall((t or "").translate(LOW)))
    out = []
    for item, own in terms.items():
        scores = []
        for i, b in bags:
            tf = collections.Counter(b)
            m = 50 + 50 * len(b) * n_all // l_all if l_all else 0
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 20 * m)) for t in own if tf[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scores)[:top])]
    return collections.Counter(out)


@pytest.mark.parametrize("block", [200_000, 60])
def test_ranked(spark, block):
    rng = random.Random(7)
    words = ["der", "Der", "été", "x1", "日本", "a", "ab", "abc", "b-c", "ÜBER", "0"] + [f"w{k}" for k in range(40)]
    docs = [(k, rng.choice([" ", ",", "\n", "--"]).join(rng.choices(words, k=rng.randint(0, 60)))) for k in range(300)]
    docs += [(k, docs[3][1]) for k in range(400, 480)] + [(7, docs[3][1])] * 3 + [(500, None), (501, ""), (502, "?! "), (None, "abc ab"), (None, "abc ab"), (503, "ab " * 150_000)]
    items = [(k, " ".join(rng.choices(words, k=8))) for k in range(12)] + [(12, None), (13, "never seen"), (14, "a"), (14, "AB"), (None, "abc"), (15, " ".join(f"w{k}" for k in range(40)))]
    extra = "long, text string, score long, rank string, term int"
    d = spark.createDataFrame([(*r, 1, "z", 2) for r in docs], f"doc_id {extra}").repartition(5)
    i = spark.createDataFrame([(*r, 1, "z", 2) for r in items], f"item_id {extra}")
    got = collections.Counter(map(tuple, ranked.ranked_search(d, i, block=block).collect()))
    assert got == rank_all(docs, items)
    if block == 60:
        assert ranked.ranked_search(d.limit(0), i).count() == 0 and ranked.ranked_search(d, i.limit(0)).count() == 0


def test_automaton_finds_whole_terms_only():
    terms = [b"ab", b"abc", "été".encode(), b"b"]
    a = ranked.Automaton(terms)
    data = ranked.FOLD[np.frombuffer("ab,abc xabc ABC été étés b bb".encode(), np.uint8)]
    w = ranked.Words(data, np.array([0, len(data)]), data > 0)
    run, term = a.scan(data, w.start, w.end - w.start)
    assert sorted(zip(run.tolist(), (terms[t] for t in term))) == [(0, b"ab"), (1, b"abc"), (3, b"abc"), (4, "été".encode()), (6, b"b")]


# spelling variants


def variants(texts):
    n = collections.Counter()
    for i, t in texts:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    cut = collections.defaultdict(set)
    for w in words:
        for k in range(len(w)):
            cut[w[:k] + "*" + w[k + 1 :]].add(w)
            cut[w[:k] + w[k + 1 :]].add(w)
    near = {w: set() for w in words}
    for k, ws in cut.items():
        for a in ws:
            if "*" in k:
                near[a] |= ws - {a}
            elif k in words:
                near[a].add(k)
                near[k].add(a)
    form = {w: min(ws, key=lambda x: (-words[x], x)) for w, ws in near.items() if ws}
    form = {w: f for w, f in form.items() if words[f] >= 10 * words[w]}
    out = []
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, words[w], len(near[w]), words[form[w]] if w in form else None))
    return collections.Counter(out)


@pytest.fixture(scope="module")
def misspelt():
    rng = random.Random(3)
    texts = []
    for i in range(150):
        said = []
        for _ in range(60):
            w = list(rng.choice(["aaaaaaa", "aaaaabb", "abababa", "ççabcdeé", "internat", "abcdefg"]))
            for _ in range(rng.randint(0, 2)):
                k, op = rng.randrange(len(w)), rng.random()
                if op < 0.33:
                    w[k] = rng.choice("abcç")
                elif op < 0.66:
                    w.insert(k, rng.choice("abcé"))
                elif len(w) > 6:
                    del w[k]
            said.append("".join(w))
        texts.append((i, " ".join(said)))
    long = "ab" * 101
    more = [f"{long} {long} {long[:-1]} {long[:-1]} {long[:-2]} {long[:-2]} {long[:100]}x{long[101:]} " * 12, f"{long[:100]}x{long[101:]} {long[1:]} {long[1:]}x {long[1:]}x {long}"]
    frequent = "internal " * 300 + "internaI internai internai INTERNAL interna1 "
    return texts + [(1000, more[0]), (1001, more[1]), (1002, frequent), (None, "Internat interńat " * 3), (None, None), (1003, ""), (0, texts[0][1])]


@pytest.mark.parametrize("most", [12, 5000])
def test_spelling(spark, misspelt, most):
    rows = [(*t, "n", "w", 1) for t in misspelt]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, key string, n int").repartition(3)
    want = variants(misspelt)
    assert any(w != r for w, _, r, *_ in want)
    assert collections.Counter(map(tuple, spelling.spelling_variants(df, most=most).collect())) == want
    if most == 5000:
        assert spelling.spelling_variants(df.limit(0)).count() == 0


def test_acceptor_is_minimal():
    words = sorted(a + b for a in ("ab", "cd", "ef") for b in ("", "x", "xyz", "q"))
    a = spelling.Acceptor(words)
    assert a.count[a.root] == len(words)
    assert len(a.arcs) == 8  # start, three that share one middle state, behind x, before z, end
    pairs = {(words[x], words[y]) for x, y in zip(*a.composed(-1))}
    one = {(u, v) for u in words for v in words if u < v and (len(u) == len(v) and sum(p != q for p, q in zip(u, v)) == 1 or abs(len(u) - len(v)) == 1 and (u in {v[:k] + v[k + 1 :] for k in range(len(v))} or v in {u[:k] + u[k + 1 :] for k in range(len(u))}))}
    assert {tuple(sorted(p)) for p in pairs} == one and len(pairs) == len(a.composed(-1)[0])


# earlier operators


def test_mixing_follows_no_layout(spark):
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, f"{k % 150} " + "w " * (5 + k % 2), f"s{k % 4}", {"a": k % 2}) for k in range(600)] + [(None, "a b c", "s1", {"a": 1})] * 60
    taken = []
    for seed, parts in ((1, 1), (2, 5)):
        mixed = rows[:]
        random.Random(seed).shuffle(mixed)
        df = spark.createDataFrame(mixed, "doc_id long, text string, source string, more map<string,int>").repartition(parts)
        taken.append(collections.Counter((r["doc_id"], r["text"], r["source"], r["more"]["a"], r["mix_taken"]) for r in mixing.mix_sources(df).collect()))
    assert taken[0] == taken[1] and sum(taken[0].values()) == 660


def test_private_data_in_a_text_of_many_matches(spark):
    n = 30_000
    text = "é " + " ".join(f"10.{k % 256}.{k // 256}.7 key={k:06d}ab" for k in range(n))
    df = spark.createDataFrame([(1, text), (2, None), (3, "a@b.co")], "doc_id long, text string")
    spans = private.private_spans(df).cache()
    found = {r["doc_id"]: r for r in spans.select("doc_id", F.filter("pii_spans", lambda s: s["base"]).alias("base")).collect()}
    at = [(m.start(), m.end()) for m in re.finditer(r"\d+\.\d+\.\d+\.\d+", text)]
    assert [(s["start"], s["end"]) for s in found[1]["base"]] == at and len(at) == n
    clean = private.redact(spans).filter("doc_id = 1").first()["text"]
    assert clean.count("[IP]") == n and clean.startswith("é [IP] key=")


def test_packing_follows_no_layout(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.when(F.col("doc_id") % 3 == 0, F.lit(5)).otherwise(F.col("doc_id")).alias("doc_id"), "text")
    docs = docs.unionByName(docs.filter("doc_id < 40"))
    one, two = (collections.Counter(map(tuple, packing.pack(docs.orderBy(order).repartition(parts), shard=50).collect())) for parts, order in ((2, "text"), (5, F.desc(F.length("text")))))
    assert one == two and sum(one.values()) > 150
