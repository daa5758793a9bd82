"""The training-data operators against brute force and SQL, on small tables with nulls, empty texts, ties and repeats."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandlog.llm import chat, context_tree, decontaminate, language, mixing, quality, repeats, sharding, suffixes, toxicity
from strandlog.llm.ngram_join import similar_components
from strandlog.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n, stem=""):
    return " ".join(stem + "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = prose(rng, 300)
    words = base.split(" ")
    near = " ".join(words[:290] + ["changed"] + words[291:])
    out = [None, "", " \n", "short text", "short text", base, base, near, prose(rng, 200), "x " * 900, "A B\tC é ü 你好", prose(rng, 4000) + " " + base,
           "".join(rng.choice("ab") for _ in range(3000)), "ab" * 900, base + "\n" + base]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i * 3, t, ("en", "de", None)[i % 3], ("s1", "s1", "s2", None)[i % 4], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF), con.sql(ORACLE[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    want = want[cols].astype(object).where(want[cols].notna(), None)
    assert sorted(map(tuple, got.select(*cols).collect()), key=repr) == sorted(map(tuple, want.itertuples(index=False)), key=repr)


# suffix arrays


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(200):
        ts = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 5))]
        s, _ = suffixes.joined(ts)
        order = s.tolist()
        assert suffixes.suffix_array(s).tolist() == sorted(range(len(order)), key=lambda i: order[i:])


def _removed(texts, size):
    data = [(t or "").encode() for t in texts]
    n = Counter(b[i : i + size] for b in data for i in range(len(b) - size + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if n[b[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        out.append((len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])),
                    hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("conf", [{}, {"many": 2}, {"size": 40, "gram": 8}, {"size": 40, "gram": 8, "chunk": 500, "many": 2}])
def test_repeats(docs, texts, conf):
    c = repeats.Repeats(**conf)
    got = by_id(repeats.without_repeats(docs, conf=c))
    want = _removed(texts, c.size)
    assert [(got[i * 3].n_bytes, got[i * 3].n_removed, got[i * 3].n_spans, got[i * 3].kept_sha256) for i in range(len(texts))] == want


def test_repeats_empty(none):
    assert repeats.repeats_table(none).count() == 0


# decontamination


def test_decontamination(spark, docs, texts):
    words = texts[5].split(" ")
    items = spark.createDataFrame([(1, " ".join(words[20:60]).upper()), (2, " ".join(words[5:25] + ["no"] + words[26:50])), (3, "never seen words are here now"),
                                   (4, "short text"), (5, None), (6, ""), (7, "x"), (None, " ".join(words[:9]))], "item_id long, text string")

    def shingles(t):
        w = WORD.findall((t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    want = set()
    for i, t in enumerate(texts):
        for r in items.collect():
            s = shingles(r.text)
            if s and len(s & shingles(t)) >= 0.8 * len(s):
                want.add((i * 3, -1 if r.item_id is None else r.item_id))
    got = decontaminate.found_items(docs, items)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and len(want) > 8
    clean = decontaminate.decontaminated(docs, items)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {i * 3 for i in range(len(texts))} - {d for d, _ in want}
    small = decontaminate.Containment(block=20)
    assert {(r.doc_id, r.item_id) for r in decontaminate.found_items(docs, items, conf=small).collect()} == want


def test_decontamination_empty(spark, docs, none):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.found_items(docs, items).count() == 0
    assert decontaminate.decontaminated(docs, items).count() == docs.count()
    assert decontaminate.found_items(none, items).count() == 0


# toxicity


def test_nearest_is_exact():
    rng = random.Random(3)
    terms = [f"t{i}" for i in range(12)]
    idf = {t: 1 + rng.random() for t in terms}
    sets = [[rng.choice(terms) for _ in range(rng.randint(0, 6))] for _ in range(400)]
    ix = toxicity.Index(toxicity.Nearest(k=7, block=8), idf, sets, np.array([rng.randint(0, 1) for _ in sets]))
    for q in sets[:80]:
        v = ix.vector(q)
        sims = [sum(x * w.get(t, 0) for t, x in v.items()) for w in ix.vectors]
        want = sorted((-round(s, 12), i) for i, s in enumerate(sims) if s > 0)[:7]
        at, got = ix.nearest(v)
        assert [i for _, i in want] == at.tolist() and np.allclose([-s for s, _ in want], got)


@pytest.mark.parametrize("whole", [0, 4, 1000])
@pytest.mark.parametrize("copies", [1, 30])
def test_nearest_of_long_lists_is_exact(whole, copies):
    """Whole rows, skipped blocks and finished rows find the neighbours that plain cosines find, also with one left out."""
    rng = random.Random(whole + copies)
    terms = [f"t{i}" for i in range(300)]
    idf = {t: 1 + rng.random() * 8 for t in terms}
    different = [Counter(rng.choices(terms, [1 / (1 + i) for i in range(300)], k=rng.randint(0, 40))) for _ in range(1200 // copies)]
    sets = different * copies
    ix = toxicity.Index(toxicity.Nearest(k=7, block=4, whole=whole), idf, sets, np.zeros(len(sets)))
    every = ix.vectors
    assert len(ix.whole) == {0: 0, 1000: len({t for s in sets for t in s})}.get(whole, len(ix.whole))
    for i in range(0, 60):
        v = ix.vector(sets[i])
        for without in (-1, i):
            sims = [sum(x * w.get(t, 0) for t, x in v.items()) for w in every]
            want = sorted((-round(s, 9), j) for j, s in enumerate(sims) if s > 0 and j != without)[:7]
            at, got = ix.nearest(v, without)
            assert len(at) == len(want) and np.allclose([-s for s, _ in want], got, atol=1e-8) and without not in at
            assert [j for _, j in want] == at.tolist()


def test_numbers_count_as_the_plain_way(monkeypatch):
    """Terms numbered by arrays are the terms of the plain count, in texts of any script and in blocks and parts of any size."""
    rng = random.Random(7)
    letters = "abcdeABZ019_-~'\n\t éÉßẞİıΣσςǅﬁ²٣漢字ñ́\u200d\U00010400\U0001f600\x00"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 120))) for _ in range(300)]
    texts += ["", " ", "_", "ΟΔΟΣ", "İstanbul Istanbul", "longword longwords LONGWO longw long", "x" * 5000, "word " * 3000, ""]
    seen = sorted({t for x in texts for t in toxicity._counts(x)})
    terms = rng.sample(seen, len(seen) // 2) + ["absent", "absen~"]
    place = {t: 2 * i for i, t in enumerate(terms)}
    names = {i: t for t, i in place.items()}
    want = [{t: n for t, n in toxicity._counts(x).items() if t in place} for x in texts]
    for block, part in ((1 << 19, 1 << 17), (1, 1), (500, 40)):
        monkeypatch.setattr(toxicity, "BLOCK_CHARS", block)
        monkeypatch.setattr(toxicity, "HASHED_CHARS", part)
        got = list(toxicity.Numbers(place).counts(texts))
        assert [{names[i]: n for i, n in zip(ids.tolist(), k.tolist())} for ids, k in got] == want
    assert [len(ids) for ids, _ in toxicity.Numbers({}).counts(texts)] == [0] * len(texts)
    assert [len(ids) for ids, _ in toxicity.Numbers(place).counts([""])] == [0] and not list(toxicity.Numbers(place).counts([]))


def test_toxicity_makes_no_string_of_a_word(spark, monkeypatch):
    """Scores come from numbered terms; the plain count by names is only for the classes."""
    rows = [(i, f"fine words number {i}", 0) for i in range(10, 30)] + [(i, f"foul words number {i}", 1) for i in range(30, 50)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, label int")
    index = toxicity.fit(frame, frame)
    monkeypatch.setattr(toxicity, "_counts", None)
    assert index.score("foul words")[0] > index.score("fine words")[0]


def test_toxicity_evidence(spark):
    """The nearest examples are named by the least doc_id of their text, and columns of the caller pass through."""
    rows = [(i, f"fine words number {i}", 0) for i in range(10, 30)] + [(i, f"foul words number {i}", 1) for i in range(30, 50)] + [(60, "foul words number 31", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, label int")
    index = toxicity.fit(frame, frame, key="doc_id")
    got = {r.doc_id: r for r in toxicity.scored(frame.withColumn("_scored", F.lit("x")), index).collect()}
    assert got[60].near[0] == got[31].near[0] == 31 and got[60].near_labels[0] == 1 and abs(got[60].near_cosines[0] - 1) < 1e-9
    assert got[60]._scored == "x" and len(got[60].near) == len(got[60].near_labels) == len(got[60].near_cosines) == 15
    empty = toxicity.scored(spark.createDataFrame([(1, None)], "doc_id long, text string"), index).first()
    assert empty.near == [] and 0 <= empty.score <= 1


def test_toxicity(spark, none):
    rng = random.Random(2)
    rows = [(i, prose(rng, 40) + (" foulness" + rng.choice(["", "er", "ing"]) if i % 5 == 0 else ""), "en", "s", 1) for i in range(400)] + [
        (1000, None, None, None, None), (1001, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(400)] + [(3, 1, None)], "doc_id long, quality int, toxic int")
    got = by_id(toxicity.toxicity_table(docs, labels))
    assert len(got) == 402
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.predicted == int(i < 400 and i % 5 == 0)
    assert toxicity.toxicity_table(none, labels).count() == 0
    assert {r.score for r in toxicity.toxicity_table(docs, labels.limit(0)).collect()} == {0.5}


def test_toxicity_keeps_rare_terms(spark):
    """A copy of a labelled toxic text is near it even if no word of it separates the classes; copies give a word no weight."""
    rng = random.Random(4)
    plain = [(i, prose(rng, 30), 0) for i in range(300)]
    toxic = [(1000 + i, prose(rng, 30) + " foulness", 1) for i in range(60)]
    odd = prose(rng, 30, "q")  # words of no other text
    rare = [(i, odd, 1) for i in range(2000, 2003)] + [(i, prose(random.Random(9), 30, "z"), 1) for i in range(3000, 3200)]
    rows = plain + toxic + rare
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t, _ in rows], SCHEMA)
    learned = spark.createDataFrame([(t, y) for _, t, y in rows], "text string, label int")
    index = toxicity.fit(learned, docs)
    assert set(index.chosen.terms) == {"foulness", "fouln~"}
    assert set(odd.split(" ")) <= set(index.every.terms)
    assert index.score(odd)[0] >= 0.7 and index.score(odd)[0] > index.score("")[0]
    assert len(index.labels) == 300 + 60 + 2


# quality


def test_quality_base(docs, texts):
    got = by_id(quality.quality_table(docs))
    for i, t in enumerate(texts):
        t = t or ""
        w = WORD.findall(t)
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        n = Counter(windows)
        covered = {k + j for k, x in enumerate(windows) if n[x] > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = got[i * 3]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert not (r.base_failed and r.kept)


def test_quality_removes_lines(spark):
    good = "These are several words of a plain sentence, which goes on for long enough to stay here."
    df = spark.createDataFrame([(1, "\n".join([good] + ["Click here to read our cookie policy"] + ["A second line has other words that never stood in the first, and so it is kept too."]), "en", "s", 0)], SCHEMA)
    out = quality.keep_clean(df).collect()
    assert len(out) == 1 and "Click" not in out[0].text and out[0].n_chars == len(out[0].text)


def test_quality_judges_each_line(spark):
    """Phrases in any case and punctuation, and words doubled but never tripled, fail in a text without any other mark."""
    bad = ["Please enable JavaScript, as this page needs it.", "Subscribe to our newsletter!", "(Click here), or wait.", "Lorem ipsum, dolor sit amet.",
           "one one two two six six ten ten."]
    rows = quality.quality_table(spark.createDataFrame([(i, x, "en", "s", 0) for i, x in enumerate(bad)], SCHEMA))
    assert {r.doc_id: r.n_removed_lines for r in rows.collect()} == dict.fromkeys(range(len(bad)), 1)


def test_quality_page_furniture(spark):
    good = "A plain line, said the author, needs no more than “this.”"
    menus = ["Products and services of our house", "Home|About|Contact|Login", "Home • About • Contact", "Start → Shop → Shoes", "• Home\n\nAbout us\nContact\n\nLog in",
             "one, two or three words of a menu " * 2]
    fine = [good, "A heading\n" + good, "- No.\n- Yes.\n- Perhaps.\n- Never.", "« Oui » « Non » dit-il, et « encore » et « toujours ».",
            "A long paragraph goes on, word by word. " * 9 + "It breaks off"]
    texts = dict(enumerate(menus + fine))
    got = by_id(quality.quality_table(spark.createDataFrame([(i, x, "en", "s", 0) for i, x in texts.items()], SCHEMA)))
    for i, x in texts.items():
        lines = sum(bool(line.strip()) for line in x.split("\n"))
        assert got[i].n_removed_lines == (lines if i < len(menus) else 0), x
        assert got[i].n_lines == x.count("\n") + 1


# chat


def test_preference_pairs(spark):
    turns = [(0, 0, "user", "q"), (0, 1, "assistant", "good"), (1, 0, "user", "q"), (1, 1, "assistant", "<|im_end|>bad"), (1, 1, "assistant", "<|im_end|>bad"),
             (2, 0, "user", None), (4, None, None, ""), (5, 0, "user", "z"), (None, 0, "user", "lost")]
    got = by_id(chat.preference_pairs(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), F.floor(F.col("conv_id") / 2),
                                      F.pmod("conv_id", F.lit(2)) == 0), "pair_id")
    assert set(got) == {0, 1, 2}
    assert got[0].prompt == "<|im_start|>user\nq<|im_end|>\n" and got[0].n_common == 1
    (span,) = got[0].rejected_spans
    assert got[0].rejected[span["start"] : span["end"]] == "< |im_end|>bad<|im_end|>"
    assert not got[1].paired and got[1].rejected is None and got[1].n_common == 0
    assert got[2].paired and got[2].n_common == 0


# sharding


def test_sharding(spark, docs, none):
    copies = spark.createDataFrame([(100 + i, "the same text", None, None, 1) for i in range(3000)] + [(5000 + i, f"text {i} " * 5, None, None, 1) for i in range(3000)], SCHEMA)
    for df in (docs, copies.unionByName(docs), docs.unionByName(docs)):
        got = sharding.shard_table(df).collect()
        assert len(got) == df.count()
        slots = defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
            assert 0 <= r.shard < 16 and r.law == "bytes"
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = Counter()
    for r in sharding.shard_table(copies).collect():
        sizes[r.shard] += r.size
    assert max(sizes.values()) < 1.05 * min(sizes.values())
    assert sharding.shard_table(none).count() == 0


# mixing


def test_raked_shares(spark):
    rows = [(i, "a b c", ("en", "en", "de")[i % 3], "hot" if i % 2 else f"s{i % 5}", 1) for i in range(6000)]
    out = mixing.mix_table(spark.createDataFrame(rows, SCHEMA)).collect()
    by_source, target = Counter(), Counter()
    for (i, *_, s, _), r in zip(rows, sorted(out, key=lambda r: r.doc_id)):
        by_source[s] += r.probability * r.tokens
        target[s] += r.tokens
    want = {s: n**0.9 for s, n in target.items()}
    for s in want:
        assert math.isclose(by_source[s] / sum(by_source.values()), want[s] / sum(want.values()), rel_tol=0.01)


def test_mixing_nulls(docs, none):
    assert mixing.mix_table(docs).count() == docs.count()
    assert mixing.sample(none).count() == 0


def test_mixing_odd_row(spark):
    """One row of a source and language of its own hardly changes what a sample holds of the others."""
    rows = [(i, "a b c " * 2000, ("en", "de")[i % 3 == 0], f"s{i % 4}", 1) for i in range(800)]
    odd = (9999, "x", None, None, 1)
    plain, more = (mixing.sample(spark.createDataFrame(t, SCHEMA)).where("doc_id < 9999").count() for t in (rows, rows + [odd]))
    assert 0.55 * 800 < plain < 0.65 * 800 and abs(more - plain) < 0.03 * 800


# language model


def _tree_log_probability(train, context, byte):
    """Natural log probability of a byte after a context: the ratio of the weighted probabilities of all training bits with and
    without the byte's own, by the definition of context-tree weighting."""
    depth = context_tree.DEPTH
    events = []
    for t in train:
        padded = bytes(depth) + t + b"\0"
        events += [(padded[i - depth : i], padded[i]) for i in range(depth, len(padded))]
    out = 0.0
    for level in range(8):
        prefix = (1 << level) | (byte >> (8 - level))
        bits = [(c, x >> (7 - level) & 1) for c, x in events if (1 << level) | (x >> (8 - level)) == prefix]

        def weighted(held, d):
            a, b = sum(x == 0 for _, x in held), sum(x == 1 for _, x in held)
            kt = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
            if d == depth:
                return kt
            below = sum(weighted([e for e in held if e[0][depth - d - 1] == c], d + 1) for c in {e[0][depth - d - 1] for e in held})
            return math.log(0.5) + max(kt, below) + math.log1p(math.exp(-abs(kt - below)))

        out += weighted(bits + [(context, byte >> (7 - level) & 1)], 0) - weighted(bits, 0)
    return out


def test_context_tree_is_the_definition(spark):
    rng = random.Random(12)
    texts = ["".join(rng.choice("ab c") for _ in range(rng.randint(0, 40))) for _ in range(12)] + ["zq", "", "abc abc"]
    rows = [(i, t, i % 3 > 0) for i, t in enumerate(texts)]
    got = by_id(context_tree.score_texts(spark.createDataFrame(rows, "doc_id long, text string, train boolean").repartition(3), "train"))
    train = [t.encode() for i, t in enumerate(texts) if i % 3 > 0]
    for i, t in enumerate(texts):
        if i % 3 == 0:
            padded = bytes(context_tree.DEPTH) + t.encode() + b"\0"
            want = sum(_tree_log_probability(train, padded[k - context_tree.DEPTH : k], padded[k]) for k in range(context_tree.DEPTH, len(padded)))
            assert math.isclose(got[i].score, want / math.log(10), rel_tol=1e-9)


def test_context_tree_is_a_distribution():
    rng = np.random.default_rng(1)
    data = np.frombuffer(bytes(rng.choice(np.frombuffer(b"abc d", np.uint8), 500)), np.uint8)
    keys, n = np.unique(context_tree.grams(data, np.array([0, 200, 500]))[0], return_counts=True)
    context = int(keys[7]) & ~255
    asked = np.setdiff1d(context + np.arange(256), keys)
    every, count = np.concatenate((keys, asked)), np.concatenate((n, np.zeros(len(asked), int))).astype(float)
    order = np.argsort(every)
    every, count = every[order], count[order]
    import pandas as pd

    one, root = context_tree.upper_nodes(pd.DataFrame(dict(zip(("node", "a", "b", "w"), context_tree.two_byte_nodes(every, count)))))
    p = np.exp(context_tree.predictions(every, count, one, root))
    assert math.isclose(p[every & ~255 == context].sum(), 1, rel_tol=1e-9)


def test_packed_keys():
    rng = np.random.default_rng(3)
    keys = np.unique(np.concatenate((rng.integers(0, 1 << 48, 500), rng.integers(1 << 62, (1 << 63) - 1, 500), [0, (1 << 63) - 1])))
    assert (context_tree.unpack_keys(context_tree.pack_keys(keys)) == keys).all() and len(context_tree.unpack(context_tree.pack(keys[:0]))) == 0
    book = context_tree.Book(keys, np.arange(len(keys)))
    assert (book[keys[::-1]] == np.arange(len(keys))[::-1]).all()


def test_pieces_of_a_long_text():
    words = [w.encode() for w in ("the", "Straße", "a", "cat's", "x" * 300, "")]
    rng = random.Random(7)
    text = np.frombuffer(b" ".join(rng.choice(words) for _ in range(12_000)) + b"y" * 2 * context_tree.CHUNK + b" end", np.uint8)
    parts = list(context_tree.pieces(text, np.array([0, len(text)])))
    assert len(parts) > 3 and [last for *_, last in parts] == [False] * (len(parts) - 1) + [True]
    for keyed in (context_tree.grams, context_tree.tokens):
        got = [keyed(*p) for p in parts]
        assert (np.concatenate([k for k, _ in got]) == keyed(text, np.array([0, len(text)]))[0]).all() and not any(r.any() for _, r in got)


@pytest.mark.parametrize("slice_", [7, 1000])
def test_merged_by_ranges(monkeypatch, slice_):
    monkeypatch.setattr(context_tree, "SLICE", slice_)
    rng = np.random.default_rng(5)
    keys = [np.sort(rng.integers(-50, k, 40 * k)) for k in (1, 3, 60)] + [np.zeros(0, np.int64)]
    n = [rng.integers(0, 9, len(k)) for k in keys]
    want = Counter()
    for k, c in zip(np.concatenate(keys), np.concatenate(n)):
        want[int(k)] += int(c)
    got = context_tree.merged(keys, n)
    assert got[0].tolist() == sorted(want) and got[1].tolist() == [want[k] for k in sorted(want)]


@pytest.mark.parametrize("n", [1, 2000])
def test_blocks_take_bounded_memory(monkeypatch, n):
    """Long or short, 8 MB of text are counted whole, in less than 100 MB beside the texts."""
    import tracemalloc

    monkeypatch.setattr(context_tree, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    words = ["%x" % (i * i) for i in range(20_000)]
    rng = random.Random(9)
    texts = [" ".join(rng.choices(words, k=1_200_000 // n)) for _ in range(n)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([True] * n), pa.array(texts)], ["k", "t", "x"])
    context_tree.word_hashes(np.zeros(1, np.uint8), np.zeros(1, int), np.ones(1, int))
    tracemalloc.start()
    out = list(context_tree._blocked([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    keys = np.concatenate([context_tree.unpack_keys(x) for b in out for x in b.column(5).to_pylist() if x])
    count = np.concatenate([context_tree.unpack(x) for b in out for x in b.column(6).to_pylist() if x])
    of_words = keys & context_tree._WORD != 0
    assert len(np.unique(keys)) == len(keys) and count[~of_words].sum() == sum(map(len, texts)) + n
    assert sorted(count[of_words]) == sorted([*Counter(w for t in texts for w in t.split()).values(), n])
    assert sum(len(b.column(3).drop_null()) for b in out) == n and peak < 100e6


def test_each_block_is_scored_by_a_task_of_its_own(spark):
    docs = spark.range(40).selectExpr("id AS doc_id", "concat('text ', id) AS text", "id < 30 AS train").repartition(8)
    out = context_tree.score_texts(docs, "train").groupBy(F.spark_partition_id()).count().collect()
    assert len(out) == 8 and sum(r["count"] for r in out) == 40


def test_log_kt():
    p = 1.0
    for i, (num, den) in enumerate([(0.5, 1), (1.5, 2), (0.5, 3)]):  # 0, 0, 1
        p *= num / den
    assert math.isclose(context_tree.log_kt(np.array([2.0]), np.array([1.0]))[0], math.log(p), rel_tol=1e-9)


def test_language_model(docs, texts, none):
    got = by_id(context_tree.language_model_table(docs))
    words = {i * 3: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None] for i, t in enumerate(texts)}
    count = Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(count.values()), len(count)
    for i, ws in words.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(count[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9) and r.score < 0
    assert context_tree.language_model_table(none).count() == 0


# language


def test_gradients():
    net = language.Network(language.ByteCnn(filters=3, embed=2, widths=(2, 3), window=10), ["a", "b"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 256, (4, 10)).astype(np.uint8), np.array([0, 1, 1, 0])

    def loss():
        z = net.logits(x)
        z = z - z.max(1, keepdims=True)
        return -(z[np.arange(4), y] - np.log(np.exp(z).sum(1))).mean()

    g = net.gradients(x, y)
    for name, at in (("f2", (1, 1)), ("o", (2, 0)), ("c", (1,)), ("e", (int(x[0, 3]), 1))):
        net.p[name][at] += 1e-6
        up = loss()
        net.p[name][at] -= 2e-6
        down = loss()
        net.p[name][at] += 1e-6
        assert abs((up - down) / 2e-6 - g[name][at]) < 1e-5


def test_language(spark, none):
    got = QUERIES["op9_language_id"](spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    rows = got.join(truth, "doc_id").where("held_out AND lang_pred <> 'und'").select((F.col("lang") == F.col("lang_pred")).alias("ok")).collect()
    assert sum(r.ok for r in rows) >= 0.97 * len(rows)
    odd = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "123 !?", "de", "s", 0), (4, "Words here", "en", "s", 1)], SCHEMA)
    assert [r.lang_pred for r in language.language_table(odd).orderBy("doc_id").collect()][:3] == ["und"] * 3
    assert language.language_table(none).count() == 0


def test_language_learns_whole_texts(spark):
    """Texts that start like those of another language teach their own from the rest."""
    rng = random.Random(6)
    head = lambda: prose(rng, 500)
    rows = [(i, head() + (" " + prose(rng, 1500, "é") if i % 2 else ""), "ab"[i % 2]) for i in range(40)]
    net = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = spark.createDataFrame([(0, head()), (1, prose(rng, 300, "é"))], "doc_id long, text string")
    assert [r.lang_pred for r in language.identify(asked, net).orderBy("doc_id").collect()] == ["a", "b"]


def test_language_keeps_copied_classes(spark):
    """A class of many copies of few texts is learned, and no class has more than its number of texts."""
    rng = random.Random(8)
    rows = [(prose(rng, 30), "a") for _ in range(300)] + [(t, c) for c in "bcdefgh" for t in [prose(rng, 30, c)] * 300]
    seen = []
    fit = language.Network.fit
    with pytest.MonkeyPatch.context() as m:
        m.setattr(language.Network, "fit", lambda net, x, y: seen.append(Counter(y.tolist())) or fit(net, x, y))
        net = language.train(spark.createDataFrame(rows, "text string, lang string"), conf=language.ByteCnn(per_class=5, epochs=1))
    assert net.classes == list("abcdefgh")
    assert seen[0][0] <= 5 * 2 and all(seen[0][k] <= 2 for k in range(1, 8))


# near duplicates


def _components(texts, size, percent):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_ngram_join(spark, docs, texts):
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in similar_components(docs).collect()} == _components(
        {i * 3: t for i, t in enumerate(texts)}, 4, 85)
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op10_ngram_jaccard_join"](spark, SF).collect()}
    assert got == _components(rows, 4, 85)


# pipeline


def test_pipeline_stages(spark, docs, none):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    assert [f for _, f in corpus_pipeline.STAGES] and corpus_pipeline.run(spark, SF).columns == table.columns + ["shard", "slot"]
    for start in (docs, none, table):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, start, SF)
            assert out.columns[: len(table.columns)] == table.columns and out.count() <= start.count()


def test_pipeline_near_duplicates(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    want = {i for i, (_, c) in _components({r.doc_id: r.text for r in table.collect()}, 5, 80).items() if i == c}
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, table, SF).collect()} == want


def test_pipeline_near_duplicates_keep_every_text(spark):
    """A shared id loses no text, rows without an id take part, and rows repeated whole stay once."""
    rng = random.Random(13)
    a, b, c = (prose(rng, 60) for _ in range(3))
    rows = [(3, a, "en", "s", 1), (5, a, "de", "s", 1), (5, b, "en", "s", 2), (None, c, "en", "s", 1), (None, c, "en", "s", 1), (None, b + " more", "en", "s", 1),
            (7, "", "en", "s", 0), (8, None, "en", "s", 0)]
    for extra in ([], ["_k", "_row", "component_id", "n", "id"]):
        df = spark.createDataFrame(rows, SCHEMA)
        for name in extra:
            df = df.withColumn(name, F.lit(1))
        out = corpus_pipeline.near_duplicates(spark, df, SF)
        assert out.columns == df.columns
        assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted([(3, a), (5, b), (None, c), (7, ""), (8, None)], key=repr)


def test_clashing_columns(spark, docs):
    """Columns with the names that operators use inside pass through untouched."""
    names = ["_g", "_n", "_pieces", "_shards", "_s", "_c", "_before", "_inside", "_p", "_r", "_m_source", "_m_lang", "_m_topic", "_lang", "_at", "key", "text_crc32"]
    df = docs
    for i, name in enumerate(names):
        df = df.withColumn(name, F.lit(i))
    for op in (sharding.sharded, mixing.mixed, quality.keep_clean, lambda d: language.identify(d, None)):
        out = op(df)
        assert out.columns[: len(df.columns)] == df.columns
        got = [tuple(r) for r in out.select(*names).collect()]
        assert set(got) <= {tuple(range(len(names)))} and len(got) in (docs.count(), quality.keep_clean(docs).count())


def _linked_sets(n, percent, rng):
    """Sets of random tokens of which some are frequent, in pairs near the threshold."""
    common = rng.integers(1, 1 << 63, 300).astype(np.uint64)
    out = []
    for _ in range(n):
        size = int(rng.integers(1, 120))
        share = rng.random()
        base = np.unique(np.concatenate((rng.choice(common, int(size * share)), rng.integers(1, 1 << 63, size - int(size * share)).astype(np.uint64))))
        drop = base[rng.random(len(base)) < percent / 100 + rng.random() * (1 - percent / 100)]
        out.append((base, np.unique(np.concatenate((drop, rng.integers(1, 1 << 63, int(rng.integers(0, 3))).astype(np.uint64))))))
    return out


@pytest.mark.parametrize("percent", [85, 80, 60, 30])
def test_linked_sets_share_a_signature(percent):
    """At every threshold, with all three classes of tokens, and combinations in use."""
    from strandlog.llm.ngram_join import NgramJoin

    rng = np.random.default_rng(percent)
    rule = NgramJoin(percent=percent, cell_bits=12, frequent=0, very_frequent=100)
    pairs = _linked_sets(600, percent, rng)
    cells = np.zeros(1 << 12, np.int64)
    for pair in pairs:
        for s in pair:
            np.add.at(cells, (s >> np.uint64(52)).astype(np.int64), 1)
    order = rule.ordered(cells)
    assert set(order.classes(order.level)) == {0, 1, 2}
    linked = combined = 0
    for a, b in pairs:
        shared = len(np.intersect1d(a, b))
        if len(a) and len(b) and rule.linked(shared, len(a), len(b)) and not np.array_equal(a, b):
            x, y = rule.prefix_signatures(a, order), rule.prefix_signatures(b, order)
            assert len(np.intersect1d(x, y))
            linked += 1
            combined += not np.isin(x, a).all()
    assert linked > 100 and combined > 20


@pytest.mark.parametrize("percent", [85, 60, 30])
def test_sketches_never_rule_out_linked_sets(percent):
    from strandlog.llm.ngram_join import NgramJoin

    rng, rule = np.random.default_rng(percent), NgramJoin(percent=percent)
    draw = lambda n: rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2)
    sets = []
    for size in (1, 5, 90, 130, 700, 5000):
        base = draw(size)
        for cut in rng.integers(0, size // 2 + 1, 12):
            sets.append(np.unique(np.concatenate((base[cut:], draw(int(rng.integers(0, cut + 1)))))))
    n = np.array([len(x) for x in sets])
    a, b = np.triu_indices(len(sets), 1)
    shared = np.array([len(np.intersect1d(sets[i], sets[j])) for i, j in zip(a, b)])
    linked = rule.linked(shared, n[a], n[b])
    maybe = rule.may_link([rule.sketch(x) for x in sets], n, a, b)
    assert linked.any() and (maybe | ~linked).all()
    if percent == 85:  # sets of too different sizes are ruled out before
        apart = ~linked & (85 * np.maximum(n[a], n[b]) <= 100 * np.minimum(n[a], n[b]))
        assert apart.sum() > 100 and (maybe & apart).sum() < 0.1 * apart.sum()


@pytest.mark.parametrize("plan", [{}, {"turns": 0}, {"block": 3, "hubs": 1, "crowd": 0}])
def test_ngram_join_of_a_large_group(spark, plan):
    """Near copies around the threshold, so that components still meet after the hubs' turn."""
    rng = np.random.default_rng(7)
    base, rows = [f"w{i}" for i in range(120)], []
    for i in range(150):
        words = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 6)):
            words[at] = f"x{rng.integers(0, 40)}"
        rows.append((i, " ".join(words)))
    sets = [{" ".join(t.split()[j : j + 4]) for j in range(117)} for _, t in rows]
    parent = list(range(150))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(150):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                lo, hi = sorted((root(i), root(j)))
                parent[hi] = lo
    got = {r.doc_id: r.component_id for r in similar_components(spark.createDataFrame(rows, "doc_id long, text string"), **plan).collect()}
    assert got == {i: root(i) for i in range(150)}
    assert len(set(got.values())) > 1


def test_ngram_join_fetches_no_sets_for_a_shared_passage(spark, monkeypatch):
    """In a large corpus many texts share a signature by chance; sketches rule them out before their sets are fetched."""
    from strandlog.llm.ngram_join import NgramJoin

    rng, real, compared = random.Random(3), NgramJoin.verified, []
    passages = [prose(rng, 12) for _ in range(41)]
    rows = [(i, " ".join((passages[i], prose(rng, 200), passages[i + 1]))) for i in range(40)]
    rows.append((40, rows[7][1] + " end"))
    monkeypatch.setattr(NgramJoin, "verified", lambda self, hubs, *rest: compared.extend(hubs.collect()) or real(self, hubs, *rest))
    got = similar_components(spark.createDataFrame(rows, "doc_id long, text string"), cell_bits=6).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i for i in range(40)} | {40: 7}
    assert len(compared) < 5


def test_components_of_few_and_of_many_edges(spark, monkeypatch):
    from strandlog.llm import components as module

    rng, parent, written = random.Random(4), list(range(400)), []

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    edges = [(i, i + 1) for i in range(300, 399)] + [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(7, 7), (3, 290), (290, 3)]
    for u, v in edges:
        lo, hi = sorted((root(u), root(v)))
        parent[hi] = lo
    want = {i: root(i) for u, v in edges if u != v for i in (u, v)}
    table = spark.createDataFrame(edges, "u long, v long").repartition(5)
    monkeypatch.setattr(module, "saved", lambda df, f=module.saved: written.append(1) or f(df))
    rows = [(r.id, r.component) for r in module.components(table).collect()]
    assert dict(rows) == want and len(rows) == len(want) and not written  # few edges take no rounds
    for few in (0, 260):  # 0: rounds only
        rows = [(r.id, r.component) for r in module.components(table, few).collect()]
        assert dict(rows) == want and len(rows) == len(want) and written
    assert not module.components(table.where("u < 0")).collect() and not module.components(table.where("u < 0"), -1).collect()
