"""The corpus operators against other libraries, brute force, SQL and hand-made cases."""

from __future__ import annotations

import hashlib
import random
import sys
import textwrap
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import corpus_pipeline  # noqa: E402
from answerrec.llm import decontam, html, langid, licenses, lines, neardup, quality, topk, toxicity  # noqa: E402
from answerrec.llm.bpe import SEGMENT, Vocabulary, decode_ids, digest_texts, encode_texts, segments  # noqa: E402
from answerrec.llm.queries import ORACLES, QUERIES, VOCABULARY  # noqa: E402
from oracle import compare, connect  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, found int, fp int, label int, _id int, _text string, _lines int, _gone int, _probability double, _row int"
LONG = "the quick brown fox jumps over the lazy dog near a river " * 3000


def odd_rows(spark):
    """Nulls in every column, empty and very long texts, repeated rows, extra columns with clashing names."""
    rows = [(1, "one two three four five six seven", "en"), (1, "one two three four five six seven", "en"), (2, None, None), (3, "", "en"), (4, LONG, "en"), (None, "a text without id here now", None), (5, "a\n\n  A\t\nb", "fr"), (6, "!!! ???", None)]
    return spark.createDataFrame([(i, t, lang, None, None, "x", 7, 8, None, 9, "y", 1, 2, 0.5, 3) for i, t, lang in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, sf_dir, name):
    assert compare(connect(sf_dir), QUERIES[name](spark, sf_dir), ORACLES[name]) == []


# encoding


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def same(vocabulary, library, texts):
    for text, packed, theirs in zip(texts, vocabulary.encode(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(packed, "<u4").tolist() == theirs.ids, text[:80]
        assert vocabulary.decode(packed) == library.decode(theirs.ids, skip_special_tokens=False)


def test_encoding_equals_the_library(library):
    vocabulary = Vocabulary(Path(VOCABULARY).read_bytes())
    rng = random.Random(5)
    letters = "aabcdeinthrsou"
    same(vocabulary, library, [" ".join("".join(rng.choices(letters, k=rng.randint(1, 40))) for _ in range(15)) for _ in range(400)])
    same(vocabulary, library, ["".join(rng.choices("aab!!?'sré<|ΣΑς 12\n\tİ\x1c\x85 漢字🙂", k=50)) for _ in range(1000)])
    same(vocabulary, library, ["", " ", "a<|endoftext|>b<|startoftext|>", "a" * 3000, "ab" * 999, "\0\0<|endoftext|>", "it's I'VE we'll'd", LONG])
    same(vocabulary, library, ["a" + chr(c) + "b " + chr(c) for c in range(32, 0x110000, 37) if not 0xD800 <= c < 0xE000])
    assert 0 < vocabulary.merged < len(vocabulary.cache)  # both ways are used


def test_encoding_odd_rows(spark):
    out = decode_ids(encode_texts(odd_rows(spark), VOCABULARY), VOCABULARY).collect()
    assert len(out) == 8 and {r["n_tokens"] for r in out if not r["text"]} == {0}
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in out)
    assert encode_texts(empty(spark), VOCABULARY, decode=True).count() == 0
    clash = odd_rows(spark).withColumn("_c", F.lit(1)).withColumn("decoded", F.lit("x")).withColumn("ids_sha256", F.lit("x"))
    both = digest_texts(encode_texts(clash, VOCABULARY, decode=True), VOCABULARY)
    assert both.count() == 8
    assert both.where(F.sha2("ids", 256) != F.col("ids_sha256")).count() == 0
    assert both.where(F.sha2(F.encode("decoded", "UTF-8"), 256) != F.col("decoded_sha256")).count() == 0
    assert digest_texts(empty(spark), VOCABULARY).count() == 0


def test_very_long_texts_are_encoded_in_segments(library):
    text = ("word after word, don't stop; " * 90_000)[:-1]
    assert len(list(segments(text))) == 3 and " ".join(segments(text)) == text and len(text) > 2 * SEGMENT
    vocabulary = Vocabulary(Path(VOCABULARY).read_bytes())
    same(vocabulary, library, [text, "x" * (SEGMENT + 5), ""])


# line dedup


def plain_lines(rows):
    key = lambda line: bytes(line.encode()).strip(b" \t\n\x0b\x0c\r").lower().decode()
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    out = {}
    for i, text in rows:
        kept = [x for x in (text or "").split("\n") if len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)]) == i]
        out[i] = "\n".join(kept)
    return out


def test_lines(spark):
    rows = [(3, "A common line here\nown line of three\n\tA COMMON LINE HERE \r\nshort"), (1, "a common line here\nshort\n\n"), (2, "Écommon line ÉÉ\nshort"), (4, "écommon line éé"), (5, "Écommon LINE ÉÉ\nécommon line éé"), (6, None), (7, "")]
    out = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["kept"] for r in out} == plain_lines(rows)
    assert {r["doc_id"]: r["n_lines"] for r in out}[6] == 1
    three = lines.dedup_lines(spark.createDataFrame([(i, "the very same line") for i in (1, 2)], "doc_id long, text string"), threshold=3)
    assert three.agg(F.sum("n_dropped")).first()[0] == 0


def test_lines_odd_rows(spark):
    out = lines.dedup_lines(odd_rows(spark))
    assert out.count() == 8 and out.where("doc_id is null and n_dropped > 0").count() == 0
    assert lines.dedup_lines(empty(spark)).count() == 0


# near duplicates


def plain_shingles(text):
    """Five-word shingles with their counts, from words found one by one; the text itself if it has no word."""
    words = []
    for word in regex.findall(r"[\p{L}\p{M}\p{N}_]+", text.lower()):
        words += [w for w in regex.split(r"([\p{Han}\p{Hiragana}\p{Katakana}])", word) if w]
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or Counter([tuple(words) or text])


def brute_classes(texts, weighted=False):
    """The smallest id of each group; texts without words belong together if they are equal."""
    sets = {i: plain_shingles(t) for i, t in texts.items()}
    sets = sets if weighted else {i: Counter(set(c)) for i, c in sets.items()}
    label = {i: i for i in texts}

    def root(i):
        return i if label[i] == i else root(label[i])

    for i, x in sets.items():
        for j, y in sets.items():
            if i < j and (x & y).total() >= 0.8 * (x | y).total():
                low, high = sorted((root(i), root(j)))
                label[high] = low
    return {i: root(i) for i in texts}


def test_near_duplicates(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(400)]
    base = [rng.choices(words, k=120) for _ in range(4)]
    texts = {}
    for i in range(60):
        copy = list(base[i % 4])
        for _ in range(i % 7):
            copy[rng.randrange(120)] = rng.choice(words)
        texts[100 - i] = " ".join(copy)
    texts |= {200: "a b", 201: "A  b!", 202: "b a", 203: " ".join(rng.choices(words, k=50))}
    out = neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in out} == brute_classes(texts)


def test_near_duplicates_count_repeats(spark):
    rng = random.Random(21)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(60)]
    texts = {}
    for i in range(60):
        base = words[20 * (i % 3) : 20 * (i % 3) + 12] * rng.randint(1, 9)
        texts[i] = " ".join([*base, *rng.choices(words, k=rng.randint(0, 8))])
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = [{r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(frame, weighted=w).collect()} for w in (False, True)]
    assert found[0] == brute_classes(texts) and found[1] == brute_classes(texts, weighted=True) and found[0] != found[1]


def test_marks_and_scripts_do_not_hide_copies(spark):
    rng = random.Random(22)
    words = ["".join(rng.choices("abcdeéñ", k=5)) for _ in range(80)]
    quoted = " ".join(words[:60])
    han = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(90))
    texts = {1: quoted, 2: "«" + " — ".join(words[:60]).replace(" — ", "\u00a0", 5) + "…»", 3: han, 4: han[:45] + "字" + han[45:], 5: han[::-1], 6: "क" * 3 + "ि " + quoted, 7: " ".join(words[20:])}
    out = neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in out} == brute_classes(texts) == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 1, 7: 7}


def test_shingles_across_buffers():
    rng = random.Random(23)
    words = ["".join(rng.choices("abcdefgh", k=7)) for _ in range(5000)]
    texts = [" ".join(rng.choices(words, k=700_000)), " ".join(words[:3]), "", "x" * 3_000_000 + " y " + "z" * 3_000_000, " ".join(words)]
    for text, (hashes, counts) in zip(texts, neardup.shingle_sets(texts)):
        expected = plain_shingles(text) if text else Counter()
        assert len(hashes) == len(expected) and counts.sum() == expected.total()
    again = neardup.shingle_sets([texts[3], " ".join(words)])
    assert (again[0][0] == neardup.shingle_sets(texts)[3][0]).all() and (again[1][0] == neardup.shingle_sets(texts[4:])[0][0]).all()


def test_near_duplicates_odd_rows(spark):
    out = neardup.near_duplicates(odd_rows(spark)).collect()
    assert Counter(r["doc_id"] for r in out) == {1: 2, 2: 1, 3: 1, 4: 1, None: 1, 5: 1, 6: 1}
    assert {r["doc_id"]: r["class_id"] for r in out if r["doc_id"] in (1, 4, 6)} == {1: 1, 4: 4, 6: 6}
    assert neardup.near_duplicates(empty(spark)).count() == 0


def test_darts_agree_as_often_as_weights_do():
    rng = np.random.default_rng(1)
    names = rng.integers(1, 2**60, 40).astype(np.uint64)
    a, b = rng.integers(1, 9, 40), rng.integers(1, 9, 40)
    rows = neardup.signatures([(np.sort(names), a), (np.sort(names), b)], k=4000)
    expected = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((rows[0] == rows[1]).mean() - expected) < 0.04
    one = neardup.signatures([(names[:1], np.array([1])), (names[:1], np.array([500]))], k=50)
    assert (one != 0).all()


# decontamination


def plain_distance(pattern, text, most):
    row, best = list(range(len(pattern) + 1)), (most + 1, -1)
    for j, c in enumerate(text):
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(row[i] + (p != c), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, (row[-1], j + 1), key=lambda x: x[0])
    return best if best[0] <= most else None


def test_bit_parallel_distance():
    rng = random.Random(3)
    for _ in range(1500):
        pattern, text = "".join(rng.choices("abc", k=rng.randint(1, 12))), "".join(rng.choices("abc", k=rng.randint(0, 30)))
        most = rng.randint(0, len(pattern) - 1)
        assert decontam.best_match(decontam.masks(pattern), len(pattern), text, most) == plain_distance(pattern, text, most)


def test_items_are_found_within_the_budget(spark):
    rng = random.Random(4)
    item = " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(40))
    edited = list(item)
    for at in rng.sample(range(len(item)), 9):
        edited[at] = "z"
    docs = [(1, "before " + item.upper().replace(" ", " -- ") + " after"), (2, "x " + "".join(edited) + " y"), (3, item[: len(item) // 2]), (4, None), (5, "")]
    items = spark.createDataFrame([(7, item), (8, "short"), (9, None), (None, item)], "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r["doc_id"]: [(f["item_id"], f["distance"]) for f in r["found"]] for r in decontam.find_items(frame, items).collect()}
    assert found == {1: [(7, 0)], 2: [(7, 9)], 3: [], 4: [], 5: []}
    in_blocks = decontam.find_items(frame, items, block=1)
    assert {r["doc_id"]: len(r["found"]) for r in in_blocks.collect()} == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0}
    odd = odd_rows(spark)
    assert decontam.decontaminate(odd, items).columns == odd.columns and decontam.decontaminate(odd, items).count() == 8
    assert decontam.find_items(empty(spark), items.limit(0)).count() == 0


def test_items_changed_or_left_in_part_are_found():
    rng = random.Random(8)
    words = lambda n: " ".join("".join(rng.choices("abcdefghijklmnopqrst", k=rng.randint(3, 7))) for _ in range(n))
    short = (words(30)[:74] + " zebras").strip()
    several = [words(14), words(15), words(13)]
    long = words(45)
    items = decontam.Items({1: decontam.stretches_of(short, 20), 2: decontam.stretches_of("\n".join(several), 20), 3: decontam.stretches_of(long, 20)}, rate=decontam.ERROR_RATE)
    around = lambda text: words(40) + " " + text + " " + words(40)
    found = lambda text: [f[0] for f in items.search(around(text))]
    assert found(short.replace("zebras", "kk")) == [1]  # one word of 81 letters
    assert found(several[0] + "\n" + several[2]) == [2] and found(several[1]) == [2]  # lines taken out
    assert found(long[60:]) == [3] and found(long[:170]) == [3]
    assert found(words(60)) == [] and found(several[0][:40]) == []


def test_all_texts_of_items_are_searched(spark):
    a, b, c, d = ("the first long passage of a benchmark item", "another passage that has the very same id", "a passage that came without any id at all", "the last passage, which is an item of its own")
    items = spark.createDataFrame([(1, a + " and more"), (1, b), (None, c), (2, d), (1, b)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " + b), (2, c + " y"), (3, a + " and more " + b), (4, d), (5, "clean")], "doc_id long, text string")
    for block in (20_000, 1):
        found = {r["doc_id"]: [(f["item_id"], f["distance"], f["letters"]) for f in r["found"]] for r in decontam.find_items(docs, items, block=block).collect()}
        assert found == {1: [(1, 0, len(b))], 2: [], 3: [(1, 0, len(a) + 9)], 4: [(2, 0, len(d) - 1)], 5: []}
        assert [r["doc_id"] for r in decontam.decontaminate(docs, items, block=block).collect()] == [5]


def test_short_items_are_found_as_whole_words(spark):
    items = spark.createDataFrame([(1, "Two words!"), (2, "ab"), (3, "..."), (1, "two"), (None, "solo"), (4, "ab")], "item_id long, text string")
    texts = {1: "here are two  WORDS.", 2: "two wordsmiths", 3: "tab, ab-c", 4: "ab", 5: None, 6: "solo"}
    docs = spark.createDataFrame([(i, t, "kept", "kept") for i, t in texts.items()], "doc_id long, text string, found string, _found_before string")
    for block in (20_000, 2):
        found = {r["doc_id"]: [tuple(f) for f in r["found"]] for r in decontam.find_items(docs, items, block=block).collect()}
        assert found == {1: [(1, 0, 9, 18, 9)], 2: [(1, 0, 0, 3, 3)], 3: [(2, 0, 4, 6, 2), (4, 0, 4, 6, 2)], 4: [(2, 0, 0, 2, 2), (4, 0, 0, 2, 2)], 5: [], 6: []}
        assert decontam.decontaminate(docs, items, block=block).count() == 6
        clean = decontam.decontaminate(docs, items, block=block, short=True)
        assert [tuple(r) for r in clean.collect()] == [(5, None, "kept", "kept")]


def test_a_pass_has_one_block_in_its_workers(spark):
    items = spark.createDataFrame([(i, f"a long enough passage of the benchmark number {i}") for i in range(9)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(9)], "doc_id long, text string")
    plan = decontam.find_items(docs, items, block=1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 0  # each pass is written before the next


def test_whole_items_and_windows_equal_brute_force():
    rng = random.Random(9)
    hits = 0
    for _ in range(60):
        item = "".join(rng.choices("abcd ", k=rng.randint(40, 130))).strip().replace("  ", " a")
        part = item[rng.choice([0, 0, 20]) :]
        for _ in range(rng.randint(0, 16)):
            at = rng.randrange(len(part))
            part = part[:at] + rng.choice(["", "c", "xx"]) + part[at + 1 :]
        text = decontam.normal("zz " * 9 + part + " yy" * 9)
        stretch = decontam.Stretch(1, decontam.normal(item), decontam.ERROR_RATE, True)
        expected = []
        for low, high in stretch.spans:
            a, b = stretch.bounds(low, high)
            pieces = stretch.groups[high - 1][1] - stretch.groups[low][0]
            if place := plain_distance(stretch.text[a:b], text, min(int((b - a) * decontam.ERROR_RATE), pieces - 1)):
                expected.append((low > 0 or high < len(stretch.groups), place[0]))
        found = decontam.Items({1: [decontam.normal(item)]}).search(text)
        assert [(f[4] < len(stretch.text), f[1]) for f in found] == [min(expected)] if expected else found == []
        hits += bool(expected)
    assert 10 < hits < 60


# top k


def plain_top_k(rows, k=20, scale=64):
    """By the contract: pairs of a query's row and any row of another id, ranked by query id."""
    whole = [(i, [int(np.floor(scale * float(np.float32(c)))) for c in v]) for i, v in rows]
    out = set()
    for q in {i for i, _ in whole if i % 20 == 0}:
        pairs = [(-sum(a * b for a, b in zip(x, y)), j) for i, x in whole if i == q for j, y in whole if j != q]
        out |= {(q, r, j, -s if abs(s) < 2**63 else None) for r, (s, j) in enumerate(sorted(pairs)[:k], 1)}
    return out


def test_top_k_with_ties_and_broken_vectors(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=4) * (1 if i % 3 else 0.2)]) for i in range(200)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(200, 280)]  # equal vectors
    rows += [rows[40], rows[41], (41, [9.0, 0.0, 0.0, 0.0]), (60, [0.0, 0.25, -1.0, 3.0])]  # ids that repeat, with and without their vector
    broken = [(1000, None), (1001, [1.0, None, 0.0, 0.0]), (1020, [float("nan"), 0.0, 0.0, 0.0]), (1040, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0, 0.0])]
    clash = "vec_id long, embedding array<float>, v int, row string, near double, cell int, pivot int, _p int"
    frame = spark.createDataFrame([(i, v, 1, "x", None, 3, 4, 5) for i, v in rows + broken], clash)
    assert {tuple(r) for r in topk.top_inner_products(frame).collect()} == plain_top_k(rows)
    assert topk.top_inner_products(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert topk.top_inner_products(spark.createDataFrame(rows[:1], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("size", [3e5, 3e6, 2e7])
def test_top_k_is_exact_for_large_components(spark, size):
    rng = np.random.default_rng(7)
    rows = [(i, [float(np.float32(x)) for x in size * (1 + 1e-7 * rng.normal(size=64))]) for i in range(60)]
    rows += [(100 + i, [float(np.float32(x)) for x in size * rng.normal(size=64)]) for i in range(40)]
    found = {tuple(r) for r in topk.top_inner_products(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert found == plain_top_k(rows)


def test_far_cells_are_not_visited(spark):
    """On vectors in far apart groups a query compares itself with few of the rows."""
    rng = np.random.default_rng(8)
    centres = 4 * rng.normal(size=(40, 8))
    rows = [(i, [float(x) for x in centres[i % 40] + 0.02 * rng.normal(size=8)]) for i in range(4000)]
    share: list[float] = []
    out = topk.top_inner_products(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), audit=share)
    assert {tuple(r) for r in out.collect()} == plain_top_k(rows)
    assert share[0] < 0.3


# classifiers


def held_out(spark, sf_dir, name, target):
    marks = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col(target).alias("truth"))
    rows = QUERIES[name](spark, sf_dir).where("held_out").join(marks, "doc_id").collect()
    assert all(0 <= r["score"] <= 1 for r in rows)
    return rows


def test_quality_on_held_out_documents(spark):
    rows = held_out(spark, "/root/testdata/sf0.01", "op5_quality", "quality")
    assert np.mean([r["predicted"] == r["truth"] for r in rows]) > 0.95


def test_toxicity_on_held_out_documents(spark):
    rows = held_out(spark, "/root/testdata/sf0.1", "op1_toxicity", "toxic")  # 35 toxic rows of sf0.01 are too few to learn from
    assert np.mean([r["predicted"] == r["truth"] for r in rows]) > 0.9
    assert sum(r["predicted"] and not r["truth"] for r in rows) <= 0.05 * len(rows)


def test_languages_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op7_language"](spark, "/root/testdata/sf0.01").where("held_out").join(docs, "doc_id").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.97


def test_classifiers_odd_rows(spark):
    odd, none, some = odd_rows(spark), empty(spark), labels(spark, [(1, 1, 0), (3, 0, 1), (4, None, None), (5, 1, 1)])
    for frame in (odd, none):
        for marks in (some, labels(spark)):
            assert quality.score_quality(frame, quality.train_quality(frame, marks)).where("score between 0 and 1").count() == frame.count()
            assert toxicity.score_toxicity(frame, toxicity.train_toxicity(frame, marks, trees=2)).where("score between 0 and 1").count() == frame.count()
        found = langid.identify(frame.withColumn("_found", F.lit(1)), langid.train_languages(frame))
        assert found.where("score between 0 and 1").count() == frame.count()
        assert found.where("text is null or text in ('', '!!! ???')").where("lang_pred <> 'und'").count() == 0
        assert licenses.scan_licenses(frame, licenses.train_licenses(frame)).where("size(licenses) = 0").count() == frame.count()


def test_licenses(spark):
    docs = [(1, "Some words.\nReleased under the MIT License.\nMore."), (2, "This work is licensed under the GNU General Public License, version 3."), (3, "Licensed under CC BY-NC 4.0."), (4, "# LICENSED UNDER THE APACHE LICENSE, VERSION 2.0."), (5, "She lost her driving license in the garden."), (6, "mit der lizenz im garten")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    out = {r["doc_id"]: [f["family"] for f in r["licenses"]] for r in licenses.scan_licenses(frame, licenses.train_licenses(frame)).collect()}
    assert out == {1: ["mit"], 2: ["gpl"], 3: ["cc"], 4: ["apache"], 5: [], 6: []}


def test_planted_licenses_of_known_and_unknown_families(spark):
    rng = random.Random(31)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model = licenses.train_licenses(docs)
    lines = [x for r in docs.orderBy("doc_id").limit(300).collect() for x in (r["text"] or "").split("\n") if x.strip() and "licen" not in x.lower()]
    talk = ["Her driving license had expired in the spring.", "The new version was shown to the public on Friday.", "He works as a general in the army and writes at night.", "Copies of the map are sold under the bridge.", "They granted him permission to stay for a week."]
    prose = lambda n: "\n".join([*rng.choices(lines, k=n), *rng.choices(talk, k=1)])
    others = ["the Boost Software License, Version 1.0", "the EUPL", "the zlib License", "the Artistic License 2.0", "the Eclipse Public License, version 1.0", "the PostgreSQL License", "the SIL Open Font License, version 1.1"]
    planted, texts = {}, {}
    for i in range(240):
        kind = rng.choice([*licenses.TEMPLATES, "unknown", "none", "none"])
        notice = "" if kind == "none" else rng.choice(["Licensed under {}.", "Released under {}.", "This program is licensed under {}."]).format(rng.choice(others)) if kind == "unknown" else rng.choice(licenses.TEMPLATES[kind])
        planted[i], texts[i] = kind, "\n".join([prose(rng.randint(1, 4)), *[notice] * bool(notice), prose(rng.randint(1, 4))])
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = {r["doc_id"]: r["licenses"] for r in licenses.scan_licenses(frame, model).collect()}
    found = {i: {f["family"] for f in r} for i, r in rows.items()}
    families = [i for i, k in planted.items() if k in licenses.TEMPLATES]
    named = [(i, f) for i, r in found.items() for f in r if f != "unknown"]
    assert np.mean([planted[i] in found[i] for i in families]) >= 0.95  # recall
    assert np.mean([planted[i] == f for i, f in named]) >= 0.95  # precision
    strange = [i for i, k in planted.items() if k == "unknown"]
    assert np.mean([found[i] == {"unknown"} for i in strange]) >= 0.9
    assert np.mean([not found[i] for i, k in planted.items() if k == "none"]) >= 0.95
    # the probability of unknown matches its frequency
    chances = [f["probability"] for i in strange for f in rows[i] if f["family"] == "unknown"]
    assert abs(np.mean(chances) - 1) < 0.2


def test_licenses_over_several_lines_and_in_long_ones(spark):
    rng = random.Random(12)
    prose = lambda n: " ".join(rng.choices("the garden river house walked slowly under morning bread table was of and in a long story".split(), k=n))
    wrapped = lambda text, mark="": "\n".join(mark + x for x in textwrap.wrap(text, 72))
    mit, bsd, gpl = licenses.TEMPLATES["mit"][2], licenses.TEMPLATES["bsd"][1], licenses.TEMPLATES["gpl"][1]
    docs = [
        (1, "Title\n\n" + wrapped(mit)), (2, wrapped(bsd, " * ")), (3, "/*\n" + wrapped(gpl, " # ") + "\n */"), (4, wrapped(mit, "dnl ")),
        (5, prose(3000) + " Released under the MIT License. " + prose(3000)), (6, prose(300) + " " + gpl + " " + prose(20000)),
        (7, prose(9) + "\n" + licenses.TEMPLATES["mit"][0] + "\nLicensed under CC BY-SA 4.0.\n" + prose(9)), (8, prose(9000)),
    ]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    out = {r["doc_id"]: r["licenses"] for r in licenses.scan_licenses(frame, licenses.train_licenses(frame)).collect()}
    assert {i: [f["family"] for f in found] for i, found in out.items()} == {1: ["mit"], 2: ["bsd"], 3: ["gpl"], 4: ["mit"], 5: ["mit"], 6: ["gpl"], 7: ["mit", "cc"], 8: []}
    assert out[1][0]["paragraph"] == 1 and out[1][0]["notice"] == wrapped(mit) and out[3][0]["overlap"] == 1


# pages


def test_layout():
    page = "<title>x</title><h1>A  b</h1><p>one<p>two<br>three<ul><li>a<li>b<ol><li>x<li>y</ol></ul><table><tr><th>Name<th>N<tr><td>Al<td>1<tr><td>Barbara<td colspan=2>2 3</table><pre> a\n  b</pre><div hidden>no</div><span style='display: none'>no</span>&eacute; &lt;<![foo<b>c<script>no</script>"
    assert html.text_of(page) == "A b\n\none\n\ntwo\nthree\n\n- a\n- b\n  1. x\n  2. y\n\nName     N\nAl       1\nBarbara  2 3\n\n a\n  b\n\né <c"
    assert html.text_of("plain text") == "plain text" and html.text_of(None) == ""
    assert html.text_of("<div>" * 3000 + "deep") == "deep" and html.text_of("</p></div><td>x") == "x"


def test_deep_pages_lose_and_show_nothing_else():
    deep = "<div>" * 170
    assert html.text_of("<div>" * 147 + "<table><tr><td>cell</td><td>two</td></tr></table>") == "cell  two"
    for n in range(140, 160):
        assert html.text_of("<div>" * n + "<table><tr><td>cell<td>two</table>").split() == ["cell", "two"]
        hidden = "a<script>no</script><style>no</style><p hidden>no</p><i style='display:none'>no</i>b"
        assert html.text_of("<div>" * n + hidden).split() == ["a", "b"] or html.text_of("<div>" * n + hidden) == "ab"
    assert html.text_of("<span hidden>" + deep + "no" + "</div>" * 170 + "</span>yes") == "yes"
    assert html.text_of("<section hidden>" + deep + "<section>no</section>no</div></section>yes") == "yes"
    assert html.text_of("<b>" * 50000 + "x" + "</b>" * 50000 + "y") == "xy"
    assert html.text_of("".join(f"<blockquote>w{i} " for i in range(5000))).split() == [f"w{i}" for i in range(5000)]
    assert html.text_of("<ul><li>" * 20000 + "x" + "<pre>" + "<i>" * 20000 + "y").split()[-2:] == ["x", "y"]


def test_tables_lose_no_text_and_keep_columns():
    assert html.text_of("<table><tr>Total<td>5</table>") == "Total\n5"
    assert html.text_of("<table><tr><b>Grand</b> total<td>x<td>1<tr><td>y<i>z</i><td>2</tr>end</table>") == "Grand total\nend\nx   1\nyz  2"
    spanned = "<table><tr><td rowspan=2>a<td>b<td>c<tr><td>d<td>e<tr><td>f<td rowspan=0 colspan=2>g<tr><td>h<td>i<tbody><tr><td>j<td>k</table>"
    assert html.text_of(spanned) == "a  b  c\n   d  e\nf  g\nh        i\nj  k"
    assert html.text_of("<p>see <svg><title>no</title><defs><text>no</text></defs><path d='M0'/><text>one</text><text>two</text></svg></p>") == "see\none\ntwo"
    assert html.text_of("so <math><semantics><mi>x</mi><mo>=</mo><mspace/><mn>5</mn><annotation>no</annotation></semantics></math>.") == "so x=5."
    rng = random.Random(14)
    tags = "p div b li ul ol table tr td th tbody thead dl h1 button span br blockquote svg math text mi".split()
    for _ in range(500):
        page, words = "", []
        for _ in range(rng.randint(1, 40)):
            if rng.random() < 0.4:
                words.append(f"w{len(words)}")
                page += f" {words[-1]} "
            else:
                page += rng.choice(["<{}>", "<{}>", "</{}>", "<{} rowspan=3>"]).format(rng.choice(tags))
        assert set(words) <= set(html.text_of(page).split()), page


def test_what_style_shows_and_hides():
    assert html.text_of("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no</div>end") == "yes\nend"
    assert html.text_of("<div style='display:none'>no<b style='visibility:visible;display:block'>no</b></div>end") == "end"
    assert html.text_of("<span style='display:block'>a</span><span style='Display: Flex'>b</span><div style='display:inline'>c</div>d") == "a\nb\ncd"
    page = "<style>/* .x{display:none} */ .h, p#q , i.k{display:none} @media print{b{display:none}} .v{visibility:hidden} div > b{display:none}</style>"
    assert html.text_of(page + "<b class=x>a</b><b class='g h'>no</b><p id=q>no</p><p>e</p><i>f</i><i class=k>no</i><u class=v>no<b style='visibility:visible'>g</b></u>") == "a\n\ne\n\nfg"
    assert html.text_of("<style>p{display:none} p.s{display:block} #t{display:none}</style><p>no<p class=s>yes<p class=s id=t>no") == "yes"
    assert html.text_of("<form>Name <input value='Ann'><input type=hidden value=no><input type=submit value=Go></form>") == "Name Ann Go"


def test_preformatted_blocks_numbers_and_wide_letters():
    assert html.text_of("<pre><div>a</div><div>b</div></pre>") == "a\nb"
    assert html.text_of("<pre>x<table><tr><td>a<td>b<tr><td>c</table>y  z</pre>") == "x\na  b\nc\ny  z"
    assert html.text_of("<ol start=3 type=a><li>x<li value=9>y<li>z</ol>") == "c. x\ni. y\nj. z"
    assert html.text_of("<ol reversed type=I><li>x<li>y<li>z</ol>") == "III. x\nII. y\nI. z"
    assert html.text_of("<ol type=A><li>x<li type=1 value=27>y<li>z<li value=0>n</ol>") == "A. x\n27. y\nAB. z\n0. n"
    assert html.text_of("<table><tr><td>漢字<td>b<tr><td>ab<td>c</table>") == "漢字  b\nab    c"
    assert html.letters_of(703) == "aaa" and html.roman(1994) == "mcmxciv"


def test_pages_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, "t"), (2, "", "t"), (2, "<p>a", None), (None, "<p>" + LONG, "t")], "page_id long, html string, text string")
    out = html.extract_text(pages)
    assert out.count() == 4 and out.where("text = ''").count() == 2 and html.extract_text(pages.limit(0)).count() == 0


# pipeline


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        before, seen = seen, stage(spark, seen, sf_dir).cache()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert seen.columns == docs.columns
        if name == "quality classifier":
            marks = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
            good = marks.join(docs, "doc_id")
            assert good.join(seen, "doc_id", "left_anti").count() <= 0.05 * good.count()
        elif name == "line dedup":
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            assert {r["doc_id"]: r["text"] for r in seen.collect()} == plain_lines(rows)
        elif name == "MinHash near-dedup":
            texts = {r["doc_id"]: r["text"] for r in before.collect()}
            assert {r["doc_id"] for r in seen.collect()} == {i for i, c in brute_classes(texts).items() if i == c}
        elif name == "benchmark decontamination":
            items = [decontam.normal(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            dirty = {r["doc_id"] for r in before.collect() if any(i in decontam.normal(r["text"]) for i in items)}
            assert {r["doc_id"] for r in before.collect()} - {r["doc_id"] for r in seen.collect()} == dirty
        else:
            library = Tokenizer.from_file(VOCABULARY)
            texts = {r["doc_id"]: r["text"] for r in before.collect()}
            for r in seen.collect():
                ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
                assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_pipeline_odd_rows(spark, sf_dir):
    for frame in (odd_rows(spark), empty(spark)):
        for _, stage in corpus_pipeline.STAGES:
            frame = stage(spark, frame, sf_dir)
            frame.count()
