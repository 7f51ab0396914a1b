from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import brute
import compare
import numpy as np
import pytest
from pyspark.sql import functions as F

from manyfold.llm import chat, fingerprint, langid, mixing, neardup, packing, quality_lm, queries, rules, template, tokens, toxicity
from manyfold.llm.common import fresh_path, written

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, score double"
R = random.Random(3)
VOCAB = ["".join(R.choice("abcdefghij") for _ in range(R.randint(2, 7))) for _ in range(300)]
EDGES = [
    (1, "", "en", "a", 0, "x", 0.0), (2, None, None, None, None, None, None), (None, "no id at all here", "en", "a", 1, "x", 0.0),
    (4, " \n\t ", "en", "b", 1, "x", 0.0), (5, "one", "en", "b", 1, "x", 0.0), (6, "One", "en", "b", 1, "x", 0.0),
    (7, "same words here " * 30, "fr", "b", 1, "x", 0.0), (7, "same words here " * 30, "fr", "b", 1, "x", 0.0), (8, "12 34 ## !!", "en", None, 1, "x", 0.0),
    (9, "long text of words " * 20_000, "en", "c", 1, "x", 0.0), (10, "déjà vu 漢字 😀 ñandú", "es", "c", 1, "x", 0.0),
]


def text(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


@pytest.fixture(scope="module")
def edge(spark):
    return written(spark.createDataFrame(EDGES, DOCS), "edge")[0]


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


# -- 1 language


def test_language_held_out_accuracy(spark):
    rows = queries.op1_language_id(spark, DIR).join(spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows) > 0


def test_language_edges(spark, edge, none):
    model = langid.train(edge)
    out = langid.predict(edge, model).collect()
    assert len(out) == len(EDGES) and set(out[0].asDict()) == {*edge.columns, "lang_pred"}
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in out if r["doc_id"] in (1, 2, 4, 8))
    assert all(0 <= r["score"] <= 1 for r in out)
    empty = langid.train(none)
    assert langid.predict(none, empty).count() == 0
    assert {r["lang_pred"] for r in langid.predict(edge, empty).collect()} == {"und"}


def test_language_scores_are_kernel_ridge():
    """With every row a landmark, scores are those of ridge regression on the plain kernel, worked out gram by gram."""
    rows = [("der hund und die katze", "de"), ("the dog and the cat", "en"), ("ein haus am see", "de"), ("a house by the lake", "en"), ("дом у озера", "ru"), ("собака и кот", "ru")]
    model = langid.fit(rows, landmarks_per_language=9)

    def squeeze(t):
        out = ""
        for ch in t.lower():
            ch = ch if ch.isalpha() else " "
            out += ch if ch != " " or not out.endswith(" ") else ""
        return out

    def grams(t):
        s = squeeze(t)
        return {s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)}

    order = [t for lang in ("de", "en", "ru") for t, x in rows if x == lang]
    used = set().union(*map(grams, order))
    unit = lambda t: grams(t) & used
    kernel = lambda a, b: len(unit(a) & unit(b)) / max(1, math.sqrt(len(unit(a)))) / max(1, math.sqrt(len(unit(b))))
    kmm = np.array([[kernel(a, b) for b in order] for a in order])
    knm = np.array([[kernel(a, b) for b in order] for a, _ in rows])
    y = np.array([[float(x == lang) for lang in ("de", "en", "ru")] for _, x in rows])
    w = np.linalg.solve(knm.T @ knm + 1e-2 * len(rows) * kmm / len(order) + 1e-6 * np.eye(len(order)), knm.T @ y)
    asked = ["der see und das haus", "the lake and a dog", "кот у дома", "12 dog!! 3"]
    langs, scores = langid.score_texts(langid.tk.plain(langid.pa.array(asked)), model)
    for t, lang, s in zip(asked, langs, scores):
        plain = np.array([kernel(t, m) for m in order]) @ w
        assert lang == ("de", "en", "ru")[plain.argmax()] and s == pytest.approx(float(np.clip(plain.max(), 0, 1)), abs=1e-3)


def test_every_language_is_learned(spark):
    rows = [(100 * k + i, f"{chr(0x4E00 + 300 * k)}{chr(0x4E01 + 300 * k)} {i}", f"l{k:02}", "s", 1, "x", 0.0) for k in range(70) for i in range(3)]
    df = spark.createDataFrame(rows, DOCS)
    out = langid.predict(df, langid.train(df)).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.95 * len(out)
    with pytest.raises(ValueError):
        langid.sample(df, F.lit(True), 9, 100, 100, max_languages=69)


def test_language_kernel_is_presence_over_shared_grams():
    model = langid.fit([("abc abc", "x"), ("xyz", "y")], landmarks_per_language=1)
    langs, scores = langid.score_texts(langid.tk.plain(langid.pa.array(["abc", "xyz xyz", "123"])), model)
    assert langs == ["x", "y", "und"] and scores[2] == 0


# -- 2 toxicity


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_agrees_with_edit_distance():
    terms = [("idiot", False), ("worthless", False), ("scum", False), ("lowei", True)]
    m, r = toxicity.Matcher(terms), random.Random(1)
    words = ["idiot", "idi0t", "idiott", "diot", "worthles", "wrothless", "scum", "scam", "loweixx", "lowi", "laweiab"]
    for _ in range(400):
        w = list(r.choice(["idiot", "worthless", "scum"]))
        for _ in range(r.randint(0, 3)):
            i = r.randrange(len(w))
            w[i : i + 1] = r.choice([[], [r.choice("abcdiotx")], [w[i], r.choice("oxt")]])
            w = w or ["a"]
        words.append("".join(w))
    words += ["xidiot", "aworthless", "abworthless", "xlowei", "xxidiot", "i", ""]
    for w in words:
        near = [(min(levenshtein(w[:i], t) for i in range(len(w) + 1)) if stem else levenshtein(w, t), k) for k, (t, stem) in enumerate(terms)]
        near = [x for x in near if x[0] <= toxicity.edits_allowed(terms[x[1]][0])]
        assert m.find(w) == (min(near) if near else None), w


def test_contractions_are_no_quotation():
    words = ["it’s", "idiot", "that’s"]
    t = "it’s an idiot that’s all"
    spans = [(x.start(), x.end()) for x in toxicity._WORD.finditer(t)]
    at = next(i for i, (a, b) in enumerate(spans) if t[a:b] == words[1])
    assert toxicity.context_factor(t, spans, at, [t[a:b] for a, b in spans], {}, 6) == 1


def test_toxicity_learns_and_spares_quotation(spark):
    rows = [(text(40, i) + (" idiot scumbag " if i % 3 == 0 else " ") + text(20, i + 1000), int(i % 3 == 0)) for i in range(300)]
    lexicon = toxicity.fit(rows)
    m = toxicity.Matcher(lexicon.terms)
    score = lambda t: toxicity.score(t, lexicon, m, {})[0]
    assert score("you idiot and scumbag there") >= 0.5 > score(text(50, 7))
    assert score("you idiott and scumbagg there") > 0.5
    assert score('he said "idiot" as a quoted word') < score("he is an idiot as all of them")
    assert score(None) == score("") == 0


def test_one_misspelled_term_is_enough(spark):
    rows = [(text(40, i) + (" worthless " if i % 3 == 0 else " ") + text(20, i + 1000), int(i % 3 == 0)) for i in range(300)]

    def score(rows, t):
        lexicon = toxicity.fit(rows)
        return toxicity.score(t, lexicon, toxicity.Matcher(lexicon.terms), {})[0]

    said = text(10, 5) + " worthles " + text(10, 6)
    assert score(rows, said) >= 0.5 > score(rows, said.replace("worthles", "worthle"))
    held = rows + [(text(60, 5000 + i) + " worthles", 0) for i in range(9)]
    assert score(held, said) < 0.5 <= score(held, said.replace("worthles", "worthless"))
    # short: by what training has of it
    few = [(text(40, i) + (" idiot " if i % 3 == 0 else " ") + text(20, i + 1000), int(i % 3 == 0)) for i in range(300)]
    some = few + [(text(60, 7000 + i) + " " + w, 1) for i, w in enumerate("idiat idoot idiut idxot ideot idyot".split())]
    assert score(few, text(10, 5) + " idjot") < 0.5 <= score(some, text(10, 5) + " idjot")


def test_toxicity_edges(spark, edge, none):
    lab = labels(spark, [(5, 1, 1), (5, 1, 0), (6, None, None), (None, 1, 1)])
    out = toxicity.predict(edge, toxicity.train(edge, lab)).collect()
    assert len(out) == len(EDGES) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    assert toxicity.predict(none, toxicity.train(none, lab)).count() == 0


# -- 3 quality


def test_model_agrees_with_plain_kneser_ney(spark):
    texts = ["abab abc", "abc abc", "ab ba", "漢字漢字", "\uffed漢字"]
    model = quality_lm.train(spark.createDataFrame([(t,) for t in texts], "text string"), shards=13)
    n, sym = quality_lm.ORDER, lambda s: [0] * (quality_lm.ORDER - 1) + [ord(c) for c in s]
    counts = {n: {}}
    for t in texts:
        s = sym(t)
        for i in range(n - 1, len(s)):
            g = tuple(s[i - n + 1 : i + 1])
            counts[n][g] = counts[n].get(g, 0) + 1
    for k in range(n - 1, 0, -1):
        counts[k] = {}
        for g in counts[k + 1]:
            counts[k][g[1:]] = counts[k].get(g[1:], 0) + 1

    def p(k: int, g: tuple) -> float:
        if k == 0:
            return 1 / quality_lm.SYMBOLS
        c = counts[k]
        cc = [sum(1 for v in c.values() if v == i) for i in (1, 2, 3, 4)]
        d = quality_lm.discounts(*cc)
        ctx = {x: v for x, v in c.items() if x[:-1] == g[:-1]}
        if not ctx:
            return p(k - 1, g[1:])
        off = lambda v: d[min(v, 3) - 1]
        total = sum(ctx.values())
        own = ctx.get(g, 0)
        return ((own - off(own)) if own else 0) / total + sum(map(off, ctx.values())) / total * p(k - 1, g[1:])

    asked = ["abc", "cab", "zz", "abab abc", "漢字ab", "字漢", "\uffed漢\uffed漢字", "\ufff0字漢字"]
    got = {r["text"]: r for r in quality_lm.scored(spark.createDataFrame([(t,) for t in asked], "text string"), model).collect()}
    for t in asked:
        s = sym(t)
        want = math.exp(-sum(math.log(p(n, tuple(s[i - n + 1 : i + 1]))) for i in range(n - 1, len(s))) / len(t))
        assert got[t]["perplexity"] == pytest.approx(want, rel=1e-4) and got[t]["lm_symbols"] == len(t)


def test_quality_rejects_junk(spark):
    rows = queries.op3_quality_classifier(spark, DIR).join(spark.read.parquet(f"{DIR}/labels.parquet"), "doc_id").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.4 * len(bad)


def test_quality_edges(spark, edge, none):
    lab = labels(spark, [(9, 1, 0), (7, 1, 0), (None, 1, 0), (7, 0, 0)])
    out = quality_lm.judged(edge, lab).collect()
    assert len(out) == len(EDGES)
    assert all(r["kept"] == (r["lm_symbols"] > 0) or r["kept"] is False for r in out)
    assert all(not r["kept"] and r["perplexity"] is None for r in out if r["doc_id"] in (1, 2))
    assert quality_lm.judged(none, lab).count() == 0
    assert quality_lm.trusted_alike(edge, labels(spark, [])).columns == edge.columns


# -- 4 tokens


@pytest.mark.parametrize("ids", [[0], [5] * 1024, list(range(1024)), [2**31, 1, 2**32 - 1], [7, 7, 900_000, 7] * 100, [1, 2, 3]])
def test_block_round_trip(ids):
    a = np.array(ids, np.uint32)
    assert tokens.decode_block(tokens.encode_block(a)).tolist() == ids


@pytest.mark.parametrize("width", range(1, 33))
def test_packed_bits_lie_on_end(width):
    r = np.random.default_rng(width)
    for n in (1, 7, 8, 9, 1000, 1024):
        v = r.integers(0, 1 << width, n).astype(np.uint32)
        bits = "".join(format(x, f"0{width}b")[::-1] for x in v.tolist())
        raw = tokens._pack(v, width)
        assert raw == bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))
        assert (tokens._unpack(raw, n, width) == v).all()


def test_file_round_trip_and_ranges():
    r, w = np.random.default_rng(1), tokens.Writer()
    docs = [(None if i == 0 else i, r.integers(0, 49_000, r.integers(0, 3000)).astype(np.uint32)) for i in range(20)]
    for i, a in docs:
        w.add(i, a)
    f = tokens.Reader(w.finish())
    at = 0
    for (i, a), (j, s, b) in zip(docs, f.documents(), strict=True):
        assert i == j and s == at and (a == b).all()
        assert (f.ids(at, at + len(a)) == a).all()
        at += len(a)


def tokenizer_path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_tokens_by_piece_are_the_library_s():
    e = tokens.Encoder(tokenizer_path())
    said = ["it's we'll DON'T 'S x'y", "a_b __ 12²½ ª µ ß É", "<|endoftext|> mid", "漢字 😀 é", "", "\xa0tab\there!!'s", "İstanbul ΑΣ"] + [text(50, i) for i in range(5)]
    assert e.by_piece
    for t, ids in zip(said, e.encode(said)):
        assert ids.tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_tokens_of_whole_texts_and_random_strings_are_the_library_s(spark):
    e, r = tokens.Encoder(tokenizer_path()), random.Random(11)
    said = [x["text"] or "" for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    latin = [chr(c) for c in (*range(32, 127), *range(160, 256), 9, 10, 13)]
    said += ["".join(r.choices(latin if i % 2 else " \n'stmdrevl12²ªµß_-aA", k=r.randint(0, 40))) for i in range(20_000)]
    for a in range(0, len(said), 2000):
        part = said[a : a + 2000]
        for t, ids, want in zip(part, e.encode(part), e.tokenizer.encode_batch(part, add_special_tokens=False), strict=True):
            assert ids.tolist() == want.ids, t


def test_buckets_give_several_files(spark, monkeypatch):
    monkeypatch.setattr(tokens, "IDS_PER_FILE", 100)  # for the driver; tasks of a local session fork from another process
    w = tokens.Writer()
    for i in range(50):
        w.add(i, np.arange(7, dtype=np.uint32))
    assert w.n == 350 and [len(x) for _, _, x in tokens.Reader(w.finish()).documents()] == [7] * 50


def test_token_query_edges(spark, edge, none):
    e = tokens.Encoder(tokenizer_path())
    folder = fresh_path(spark, "tok")
    manifest, _ = written(tokens.write(edge, tokenizer_path(), folder, 2, rows_per_bucket=3), "m")
    got = sorted((r["start"], r["n_tokens"], r["ids_crc32"], r["doc_id"]) for r in tokens.read(spark, manifest, folder).collect())
    rows = sorted(EDGES, key=lambda r: (r[0] is not None, r[0] or 0))
    at = 0
    for r, (start, n, crc, doc_id) in zip(rows, got, strict=True):
        ids = np.array([*e.tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (start, n, crc, doc_id) == (at, len(ids), zlib.crc32(ids.tobytes()), r[0])
        at += n
    folder = fresh_path(spark, "tok")
    manifest, _ = written(tokens.write(none, tokenizer_path(), folder, 2), "m")
    assert tokens.read(spark, manifest, folder).count() == 0


# -- 5 chat


@pytest.mark.parametrize(
    ("source", "values", "want"),
    [
        ("a{{ 1 + 2 }}b", {}, "a3b"), ("{% if x == 'q' and not y %}1{% elif y %}2{% else %}3{% endif %}", {"x": "q", "y": True}, "2"),
        ("{% for m in ms %}{{ loop.index }}{{ m.t | upper }}{% if not loop.last %},{% endif %}{% endfor %}", {"ms": [{"t": "a"}, {"t": "b"}]}, "1A,2B"),
        ("{% set z = 'k' ~ 1 %}{{ z }}{# gone #}{{ none }}", {}, "k1"), ("x {{- ' y ' -}} z", {}, "x y z"), ("{{ a[1] }}{{ a[9] | default('-') }}{{ a.__class__ }}", {"a": [1, 2]}, "2-"),
        ("{{ 'in' if_ }}" if False else "{{ 'a' in 'abc' }}", {}, "true"),
    ],
)
def test_template(source, values, want):
    assert "".join(t for t, _ in template.compiled(source)(**values)) == want


@pytest.mark.parametrize("source", ["{{ 1 + }}", "{% if x %}", "{% for x y %}{% endfor %}", "{{ f(1) }}", "{{ x | nope }}", "{% nope %}", "{{ 1 + 'a' }}", "{{ x"])
def test_template_errors(source):
    with pytest.raises(template.TemplateError):
        template.parse(source)


def test_template_folds_and_marks():
    assert template.parse("a{{ 'b' ~ 1 }}{% if 1 == 2 %}x{% else %}c{% endif %}") == (template.Text("ab1c"),) or "".join(n.text for n in template.parse("a{{ 'b' ~ 1 }}{% if 1 == 2 %}x{% else %}c{% endif %}")) == "ab1c"
    assert list(template.compiled("a{% generation %}b{% endgeneration %}c")()) == [("a", False), ("b", True), ("c", False)]


@pytest.mark.parametrize("t", ["", "\\", "\\0", *chat.CONTROLS, "".join(chat.CONTROLS), "<|te<|text|>xt|>", "a\\<|end|>\\", "<|tur", "n|>"])
def test_escape_round_trip(t):
    assert chat.unescape(chat.escape(t)) == t and not any(c in chat.escape(t) for c in chat.CONTROLS)


def test_chat_round_trip(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART", 50)
    rows = [(1, 2, "assistant", "b</s>"), (1, 1, "user", "a"), (1, 3, "assistant", "😀"), (2, 1, None, None), (None, 1, "user", "x"), (3, 1, "assistant", "y" * 500), (3, 1, "assistant", "y" * 500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(written(chat.formatted(df), "parts")[0]).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: r[1:])
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        learned = "".join(r[3] for r in own if r[2] == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert chat.formatted(df.limit(0)).count() == 0


# -- 6 near-duplicates


def family(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    base = text(r.choice([6, 40, 150]), seed).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, max(1, len(w) // 12))):
            w[r.randrange(len(w))] = r.choice(VOCAB)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_agree_with_brute_force(spark, width, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)  # so that families take several blocks
    texts = [t for k in range(8) for t in family([3, 30, 5, 12, 2, 40, 7, 4][k], k)] + [text(60, 900 + i) for i in range(40)] + ["", None, "one", "ONE", "one two", " "]
    rows = list(enumerate(texts, 10))
    want = brute.components(rows, width, 80)
    out = neardup.linked(spark.createDataFrame(rows, "doc_id long, text string"), width, 80).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) and r["n_shingles"] == len(brute.shingles(dict(rows)[r["doc_id"]], width)) for r in out)


def test_near_duplicate_edges(spark, edge, none):
    out = neardup.linked(edge, 2, 80).collect()
    assert len(out) == len(EDGES)
    by = {r["doc_id"]: r for r in out}
    assert by[None]["kept"] and by[None]["component_id"] is None and by[6]["component_id"] == 5 and by[1]["kept"] and by[2]["kept"]
    left = neardup.deduplicated(edge, width=2, percent=80)
    assert left.columns == edge.columns and sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 1, 2, 4, 5, 7, 8, 9, 10]
    assert neardup.linked(none).count() == neardup.deduplicated(none).count() == 0


def test_near_duplicates_with_repeated_ids(spark):
    a, b, c = text(60, 1), text(60, 2), text(60, 3)
    rows = [(1, a), (1, b), (1, b), (2, b + " more"), (3, a), (3, c), (4, c.upper()), (4, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.linked(df, 2, 80).collect())
    assert got == [(1, 1, True)] * 3 + [(2, 1, False), (3, 1, False), (3, 3, True), (4, 3, False), (4, 3, False)]
    assert sorted(tuple(r) for r in neardup.deduplicated(df, width=2).collect()) == sorted([(1, a), (1, b), (3, c)])


def test_near_duplicates_on_a_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r["component_id"] for r in queries.op6_minhash_near_dedup(spark, "/root/testdata/sf0.01").collect()}
    assert got == brute.components(rows, 2, 80)


def test_least_shared_bounds_the_chance_of_a_miss():
    for miss in (1e-8, 1e-4):
        m = neardup.least_shared(64, 80, miss)
        tail = lambda m: sum(math.comb(64, i) * 0.8**i * 0.2 ** (64 - i) for i in range(m))
        assert tail(m) <= miss < tail(m + 1)
    assert neardup.least_shared(64, 80, 0) == 1


def test_components_raise_when_not_settled(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {r["comp"] for r in neardup.components(path, "t").collect()} == {0}
    with pytest.raises(RuntimeError):
        neardup.components(path, "t", most_rounds=2)


# -- 7 fingerprints


def test_fingerprints_follow_the_definition(spark, monkeypatch):
    rows = [(i, text(30 + 40 * i, i)) for i in range(12)] + [(50, ""), (51, None), (52, "abc"), (53, "é" * 9), (54, "x" * 3000)]
    out = {r["doc_id"]: r for r in fingerprint.with_neighbours(spark.createDataFrame(rows, "doc_id long, text string"), rows_per_bucket=4).collect()}
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        q = len(t) // 4
        new = t[: len(t) - q] + after[:q]
        r = out[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        a, b = fingerprint.digests([t.encode()])[0], fingerprint.digests([new.encode()])[0]
        assert r["fingerprint"] == fingerprint.as_text(a) and r["edited_fingerprint"] == fingerprint.as_text(b)
        assert r["near_edited"] == pytest.approx(fingerprint.likeness(a, b)) and 0 <= r["near_next"] <= 1
    assert min(out[i]["near_edited"] for i in range(2, 12)) > 0.3 > max(out[i]["near_next"] for i in range(1, 11))


def plain_digest(b: bytes) -> np.ndarray:
    """The docstring's definition, window by window."""
    w, m = fingerprint.WINDOW, len(b) - fingerprint.WINDOW + 1
    rank = [sum(int(fingerprint._G[c]) for c in Counter(b[i : i + w]).values()) for i in range(m)]
    strong = [x <= fingerprint._WEAK for x in rank]
    usable = strong if any(strong) else [True] * m
    keys = [((rank[i] >> 10) if usable[i] else 1 << 30, i) for i in range(m)]
    if m < fingerprint.RUN + fingerprint.LEAST_WINS:
        at = sorted(i for _, i in sorted(k for k, u in zip(keys, usable) if u)[: max(1, m // 4)])
    else:
        wins = Counter(min(keys[j : j + fingerprint.RUN])[1] for j in range(m - fingerprint.RUN + 1))
        at = sorted(i for i, n in wins.items() if n >= fingerprint.LEAST_WINS and usable[i])
    data = np.frombuffer(b, np.uint8)
    seen: list[int] = []
    for i in at:
        h = int(fingerprint.tk.span_hashes(data[i : i + w], np.array([0]), np.array([w]))[0])
        if h not in seen:
            seen.append(h)
    if not seen and b:  # without features: windows of 8 bytes
        seen = list(dict.fromkeys(int(fingerprint.tk.span_hashes(data, np.array([i]), np.array([i + 8]))[0]) for i in range(len(b) - 7)))
    chain = np.zeros((-(-len(seen) // fingerprint.PER_FILTER), fingerprint.BITS), bool)
    for k, h in enumerate(seen):
        for j in range(fingerprint.HASHES):
            chain[k // fingerprint.PER_FILTER, (h >> (12 * j)) % fingerprint.BITS] = True
    return np.packbits(chain, axis=1)


def test_digests_agree_with_plain_windows():
    texts = [text(n, n).encode() for n in (8, 12, 20, 60, 300, 900)] + [b"x" * 300, ("é漢" * 80).encode(), (text(90, 4) + "-" * 200 + text(50, 5)).encode()]
    for got, b in zip(fingerprint.digests(texts), texts):
        assert got.tolist() == plain_digest(b).tolist()


def test_entropy_sums_by_hand():
    data = np.random.default_rng(2).integers(97, 103, 200).astype(np.uint8)
    sums = fingerprint._entropy_sums(data)
    for i in (0, 1, 57, 168):
        _, c = np.unique(data[i : i + fingerprint.WINDOW], return_counts=True)
        assert sums[i] == sum(int(fingerprint._G[x]) for x in c)


def test_fingerprint_edges(spark, edge, none):
    assert fingerprint.with_neighbours(edge).count() == len(EDGES) and fingerprint.with_neighbours(none).count() == 0
    assert fingerprint.fingerprints(edge).columns == [*edge.columns, "fingerprint"]


# -- 8 mixing


def test_sainte_lague_is_highest_quotients():
    for shares, seats in (([5.0, 2.0, 1.0], 13), ([1.0] * 7, 3), ([53, 24, 23], 7), ([1e9, 1.0, 0.0], 11), ([], 3)):
        want = [0] * len(shares)
        for _ in range(seats if sum(shares) else 0):
            i = max(range(len(shares)), key=lambda i: (shares[i] / (2 * want[i] + 1), -i))
            want[i] += 1
        assert mixing.sainte_lague(list(map(float, shares)), seats) == want


def test_targets_share_what_caps_refuse():
    got = mixing.targets([10, 100, 1000, 0], [5, 2, 1, 5], 1665, 2.0)
    assert got[0] == 20 and got[1] == 200 and got[2] == pytest.approx(1445) and got[3] == 0


def test_mixture(spark, edge, none):
    rows = [(i, text(20 + i % 50, i), "en", f"s{i % 3}" if i % 4 else "hot", 1, "x", 0.0) for i in range(400)]
    df = spark.createDataFrame(rows, DOCS)
    out = mixing.mixed(df, shard_rows=60, block=8).collect()
    assert len(out) == 400 and all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    for s in {r["source"] for r in out}:
        own = [r for r in out if r["source"] == s]
        assert {r["source_size"] for r in own} == {sum(r["size"] for r in own)} and sum(r["taken"] for r in own) == pytest.approx(own[0]["target"], abs=60)
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, mixing.mixed(df, shard_rows=60, block=8).collect()), key=str)
    assert mixing.mixture(df).columns == df.columns
    assert mixing.mixed(edge).count() == len(EDGES) and mixing.mixed(none).count() == 0 and mixing.mixture(none).count() == 0
    assert all(r["taken"] == 0 for r in mixing.mixed(edge).collect() if r["doc_id"] in (1, 2, 4))


def test_many_null_ids_are_told_apart(spark):
    rows = [(None, text(20 + i % 50, i), "en", "hot", 1, "x", 0.0) for i in range(300)] + [(i, text(30, i), "en", "b", 1, "x", 0.0) for i in range(50)]
    df = spark.createDataFrame(rows, DOCS)
    out = mixing.mixed(df, shard_rows=60, block=8).collect()
    hot = [r for r in out if r["source"] == "hot"]
    assert len(out) == 350 and sum(r["taken"] for r in hot) == pytest.approx(hot[0]["target"], abs=60)
    assert len({r["bin_id"] >> 32 for r in packing.packed(df, shard_rows=60).collect()}) >= 4


# -- 9 packing


def test_packing_keeps_every_rule(spark, edge, none):
    rows = [(i, text(1 + i % 90, 5 if i % 5 == 0 and i % 90 == 10 else i), "en", "hot" if i % 3 else f"s{i % 7}", 1, "x", 0.0) for i in range(600)]
    out = packing.packed(spark.createDataFrame(rows, DOCS), capacity=64, source_limit=2, shard_rows=200).collect()
    bins: dict = {}
    for r in out:
        bins.setdefault(r["bin_id"], []).append(r)
    for own in bins.values():
        assert sum(r["n_words"] for r in own) <= 64 and len({r["cluster"] for r in own}) == len(own) and sorted(r["place"] for r in own) == list(range(len(own)))
        assert all(sum(r["source"] == s for r in own) <= 2 for s in {r["source"] for r in own})
    size: dict = {}
    for r in out:
        size[r["doc_id"]] = size.get(r["doc_id"], 0) + r["n_words"]
    assert size == {i: len(t.split()) for i, t, *_ in rows}
    got = packing.packed(edge).collect()
    assert all(r["bin_id"] is None for r in got if r["doc_id"] in (1, 2, 4)) and {r["doc_id"] for r in got} == {r[0] for r in EDGES}
    assert packing.packed(none).count() == 0


def test_one_source_still_fills_bins(spark):
    rows = [(i, text(100 + 13 * i % 500, i), "en", None, 1, "x", 0.0) for i in range(300)]
    out = packing.packed(spark.createDataFrame(rows, DOCS)).collect()
    assert sum(r["n_words"] for r in out) >= 0.9 * 2048 * len({r["bin_id"] for r in out})
    said = packing.packed(spark.createDataFrame([(1, "\tfoo bar", "en", "a", 1, "x", 0.0), (2, "Foo  bar\n", "en", "a", 1, "x", 0.0)], DOCS)).collect()
    assert said[0]["cluster"] == said[1]["cluster"] and said[0]["bin_id"] != said[1]["bin_id"]


def test_best_fit_is_the_tightest_compatible_bin():
    rows = [(i, f"s{R.randrange(5)}", R.randrange(40), R.randint(1, 30)) for i in range(300)]
    got = list(packing.pack_shard(0, rows, 32, 2))
    bins: dict[int, list] = {}
    for bin_id, _, _, source, cluster, _, _, n in got:  # in the order in which they were placed
        fits = {b: 32 - sum(x[2] for x in own) for b, own in bins.items() if 32 - sum(x[2] for x in own) >= n and cluster not in {x[1] for x in own} and sum(x[0] == source for x in own) < 2}
        if bin_id in bins:
            assert fits[bin_id] == min(fits.values())
        else:
            assert not fits
        bins.setdefault(bin_id, []).append((source, cluster, n))


# -- 10 rules


def test_counts_agree_with_brute_force(spark, edge, documents):
    for df in (edge, documents):
        rows = df.select("doc_id", "text").collect()
        got = sorted(tuple(r[c] for c in rules.COUNTS) for r in rules.with_counts(df, ["doc_id"]).collect())
        assert got == sorted(brute.counts(r["text"]) for r in rows)


def simulated(n: int, on_good: tuple, on_bad: tuple, seed: int) -> list:
    r, found = random.Random(seed), {}
    for _ in range(n):
        good = r.random() < 0.85
        votes = tuple((1 if r.random() < a else -1) if good else (-1 if r.random() < b else 1) for a, b in zip(on_good, on_bad))
        found[votes] = found.get(votes, 0) + 1
    return sorted(found.items())


def test_em_finds_accuracies():
    names, on_good, on_bad = list("abcd"), (0.98, 0.97, 0.8, 0.95), (0.9, 0.85, 0.3, 0.6)
    w = rules.estimate(simulated(20_000, on_good, on_bad, 5), names)
    assert w.converged
    for r, a, b in zip(names, on_good, on_bad):
        assert w.accuracy[r] == (pytest.approx(a, abs=0.03), pytest.approx(b, abs=0.1))
    assert not rules.estimate(simulated(20_000, on_good, on_bad, 5), names, rounds=2).converged


def test_posterior_is_bayes_rule():
    names = list("abcd")
    w = rules.estimate(simulated(20_000, (0.98, 0.97, 0.8, 0.95), (0.9, 0.85, 0.3, 0.6), 5), names)
    share = 1 / (1 + math.exp(-w.prior))
    p = lambda votes: 1 / (1 + math.exp(-w.prior - sum(w.good[r] if v > 0 else w.bad[r] if v < 0 else 0 for r, v in zip(names, votes))))
    for votes in ((1, 1, -1, 1), (-1, -1, 1, 1), (1, 0, -1, 0), (0, 0, 0, 0)):
        good, bad = share, 1 - share
        for r, v in zip(names, votes):
            a, b = w.accuracy[r]
            good *= a if v > 0 else 1 - a if v < 0 else 1
            bad *= 1 - b if v > 0 else b if v < 0 else 1
        assert p(votes) == pytest.approx(good / (good + bad))
    # a bad vote of the poor rule is outweighed, one of a good rule isn't where the others abstain
    assert p((1, 1, -1, 1)) > 0.5 > p((-1, 0, 0, 0)) and p((-1, -1, 1, 1)) < 0.5


def test_one_bad_vote_is_no_verdict(spark):
    """On a whole table: of the texts with bad votes some are kept and some are not, and labels agree."""
    counted, _ = written(rules.with_counts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), ["doc_id"]), "counted")
    bad = sum(((v == -1).cast("int") for v in rules.rules().values()), F.lit(0))
    weights = rules.fit(counted)
    out = rules.judged(counted, weights).withColumn("bad", bad).where("not base_failed")
    rows = out.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id", "left").collect()
    assert weights.converged and any(r["kept"] and r["bad"] for r in rows) and any(not r["kept"] for r in rows)
    assert all(r["bad"] for r in rows if not r["kept"])
    good, poor = [r["kept"] for r in rows if r["quality"] == 1], [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) >= 0.97 * len(good) and sum(poor) <= 0.1 * len(poor)


def test_rules_take_any_names(spark):
    df = spark.createDataFrame([(1, "some words", "a", "b", "c", "d")], "doc_id long, text string, _t string, _s string, _w string, `o.k` string")
    assert rules.with_counts(df, df.columns).columns == [*df.columns, *rules.COUNTS[:4], "n_repeat_words", *rules.MORE]


def test_rules_edges(spark, edge, none):
    counted = rules.with_counts(edge, edge.columns)
    out = rules.judged(counted, rules.fit(counted)).collect()
    assert len(out) == len(EDGES) and all(r["base_failed"] and not r["kept"] for r in out if r["doc_id"] in (1, 2, 4, 5))
    empty = rules.with_counts(none, ["doc_id"])
    assert rules.judged(empty, rules.fit(empty)).count() == 0


def test_rules_plan_has_no_python(spark, documents):
    counted = rules.with_counts(documents, ["doc_id"])
    plan = rules.judged(counted, rules.fit(counted))._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))


def test_language_is_not_an_input(spark, documents):
    model = langid.train(documents)
    a = langid.predict(documents.select("doc_id", "text"), model)
    b = langid.predict(documents.select("doc_id", "text", F.lit("zz").alias("lang")), model).select("doc_id", "text", "lang_pred", "score")
    assert a.exceptAll(b).isEmpty()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    assert compare.differences(queries.queries()[name](spark, DIR), compare.duck(DIR), queries.oracle_sql()[name]) is None
