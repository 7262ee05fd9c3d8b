"""Token counts, packing, language, toxicity and fingerprints against brute force and on odd tables."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from casework.llm import language, toxicity
from casework.llm.forest import Forest
from casework.llm.gray_index import GrayIndex, hamming_links
from casework.llm.packing import best_fit, pack
from casework.llm.queries import QUERIES
from casework.llm.sampling import remainder
from casework.llm.simhash import fingerprint, near_duplicates, without_near_duplicates
from casework.llm.token_counts import token_counts, vocabulary
from conftest import SMALL
from odd_tables import no_docs, odd_texts, workers  # noqa: F401  fixtures


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(library, texts):
    return [code.ids for code in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_ids_are_the_librarys(library):
    rng = random.Random(5)
    signs = [*" \n\t\r ab'sTllre109½²Ⅷé中ñ.,!?<|>_\x85\xa0　\x1c\x1f​́\U0001f600", "<|endoftext|>", "'s", "  "]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 60))) for _ in range(3000)]
    texts += [None, "", "a" * 5000, " " * 3000, "<|endoftext|>" * 3]
    for coded, ids in zip(vocabulary().encode(texts), ids_of(library, texts), strict=True):
        assert np.frombuffer(coded, "<u4").tolist() == ids


def test_token_counts(spark, library, odd_texts, no_docs):
    rows = odd_texts.select("doc_id", "text").collect()
    found = token_counts(odd_texts).collect()
    counts = [len(x) for x in ids_of(library, [r["text"] for r in rows])]
    sizes = [len((r["text"] or "").encode()) for r in rows]
    expected = [(r["doc_id"], b, n, n > 512) for r, b, n in zip(rows, sizes, counts, strict=True)]
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)
    assert token_counts(no_docs).count() == 0


def test_packing_round_trip(spark, library, odd_texts, no_docs):
    found = pack(odd_texts.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()
    texts = dict(odd_texts.where("doc_id is not null").select("doc_id", "text").collect())
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for (doc, text), ids in zip(texts.items(), ids_of(library, texts.values()), strict=True):
        ids = [*ids, 2]
        own = sorted(pieces[doc], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and len(own) == -(-len(ids) // 1024)
        assert all(r["length"] == 1024 for r in own[1:])
        assert [r["start"] for r in own] == [sum(x["length"] for x in own[:i]) for i in range(len(own))]
        for r in own:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert r["ids_crc32"] == zlib.crc32(part.tobytes()) and len(part) == r["length"]
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [sum(x["length"] for x in own[:i]) for i in range(len(own))]
        assert sum(r["length"] for r in own) <= 1024
    assert pack(odd_texts).count() >= odd_texts.count()
    assert pack(no_docs).count() == 0


def test_attention_binds_beside_the_token_capacity(spark):
    def costs(n, attention):
        rows = [(i, "word " * n) for i in range(4)]
        found = pack(spark.createDataFrame(rows, "doc_id long, text string"), attention=attention).collect()
        sequences = defaultdict(list)
        for r in found:
            sequences[r["sequence_id"]].append(r["length"])
        return list(sequences.values())

    long = costs(489, 700 * 700)  # pieces of about 490 tokens: two fit by tokens and by cost
    assert len(long) == 2 and all(sum(x) > 700 for x in long)
    tight = costs(489, 600 * 600)  # two fit by tokens, not by cost
    assert len(tight) == 4 and all(sum(n * n for n in x) <= 600 * 600 for x in tight)


@pytest.mark.parametrize("select", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(select):
    lengths = np.random.default_rng(1).integers(1, 101, 700)
    sequence, offset = best_fit(lengths, 100, 3, 5000.0, select=select)
    for s in np.unique(sequence):
        own = np.flatnonzero(sequence == s)
        if len(own) > 1:
            assert (lengths[own] ** 2).sum() <= 5000
        own = own[np.argsort(offset[own])]
        assert len(own) <= 3 and lengths[own].sum() <= 100
        assert offset[own].tolist() == (np.cumsum(lengths[own]) - lengths[own]).tolist()
    free, _ = best_fit(lengths, 100, 700, 1e9, select=select)
    assert free.max() + 1 <= lengths.sum() / 100 * 1.05


def test_language_by_words_then_grams(spark, odd_texts, no_docs):
    rows = [(i, "the cat sat on the mat" if i % 2 else "der hund lief zum haus", "en" if i % 2 else "de") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, F.lit(True))
    assert model.langs == ["de", "en"]
    asked = spark.createDataFrame([(1, "the mat"), (2, "haus"), (3, "cats"), (4, "hunde"), (5, "42 !"), (6, None)], "doc_id long, text string")
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(asked, model).collect()}
    assert [found[i][0] for i in range(1, 7)] == ["en", "de", "en", "de", "und", "und"]
    assert found[5][1] == found[6][1] == 0 and all(0.5 < found[i][1] <= 1 for i in range(1, 5))
    odd = language.identify(odd_texts, model)
    assert set(odd_texts.columns) | {"lang_pred"} == set(odd.columns)  # its own score is replaced
    assert all((r["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", r["text"] or "")) for r in odd.collect())
    assert language.identify(no_docs, model).count() == 0
    nothing = language.fit(no_docs, F.lit(True))
    assert {r["lang_pred"] for r in language.identify(odd_texts, nothing).collect()} == {"und"}


def test_rare_languages_are_known(spark, monkeypatch):
    rng = random.Random(8)
    # a long tail of words in the hot language; eight documents of the rare one, half of them learned from
    words = {"hot": ["".join(rng.choices("abcdefghij", k=6)) for _ in range(3000)], "rare": ["".join(rng.choices("mnopqrstuv", k=6)) for _ in range(60)]}
    rows = [(i, " ".join(rng.choices(words[lang], k=30)), lang) for i in range(4000) for lang in ["rare" if i % 500 == 3 else "hot"]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for name, most in (("WORDS", 400), ("GRAMS", 400), ("LEAST_ROWS", 20), ("LEAST_ITEMS", 100)):
        monkeypatch.setattr(f"casework.llm.language.{name}", most, raising=False)
    model = language.fit(docs, F.col("doc_id") % 1000 < 500, rows=100)
    assert model.langs == ["hot", "rare"]
    found = language.identify(docs, model).where("doc_id % 1000 >= 500 and (doc_id < 1000 or lang = 'rare')")
    assert found.where("lang != lang_pred").count() == 0 and found.where("lang = 'rare'").count() == 4


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    found = QUERIES["op3_language_id"](spark, SMALL).join(docs, "doc_id").where("held_out")
    right, total = found.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert total > 20 and right / total > 0.95


def test_toxicity(spark, odd_texts, no_docs):
    rng = random.Random(3)
    words = ["sun", "river", "stone", "walk", "green", "letter", "you", "your", "table", "night"]
    rows, labels = [], []
    for i in range(400):
        text = [rng.choice(words) for _ in range(30)]
        if i % 4 == 0:
            text[rng.randrange(30)] = "blarg" + rng.choice(["ig", "on", "us"])
        rows.append((i, " ".join(text)))
        labels.append((i, 1 if i % 4 == 0 else 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1), (1, None)], "doc_id long, toxic int")
    held_out = remainder("doc_id", 5) == 0
    model = toxicity.fit(docs, marks, ~held_out, trees=3)
    found = toxicity.toxicity(docs, model).join(marks.where("toxic is not null"), "doc_id").where(held_out)
    rows = found.collect()
    assert sum(r["predicted"] == r["toxic"] for r in rows) / len(rows) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    odd = toxicity.toxicity(odd_texts, model)
    assert odd.columns == ["doc_id", "score", "predicted"] and odd.where("score is null").count() == 0
    assert odd.count() == odd_texts.count() and toxicity.toxicity(no_docs, model).count() == 0
    for one in (marks.where("toxic = 1"), marks.limit(0)):
        same = toxicity.fit(docs, one, F.lit(True))
        assert {r["score"] for r in toxicity.toxicity(docs, same).collect()} == {1.0 if one.count() else 0.0}


def brute_print(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> i & 1 for h in hashes) > len(hashes)) << i for i in range(64))


def test_fingerprints():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choices("ab \n\tÉX\x0b\x1f\x85", k=rng.randint(0, 40)))
        assert fingerprint(text, 3) == brute_print(text, 3)


def clustered_codes(seed=0):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 600, dtype=np.uint64)
    near = base[rng.integers(0, 30, 900)].copy()
    for _ in range(4):
        flip = np.uint64(1) << rng.integers(0, 64, 900, dtype=np.uint64)
        near ^= np.where(rng.random(900) < 0.6, flip, np.uint64(0))
    return rng.permutation(np.unique(np.concatenate([base, near])))


def brute_labels(codes, limit):
    forest = Forest(len(codes))
    forest.link(*np.nonzero(np.bitwise_count(codes[:, None] ^ codes[None]) <= limit))
    return forest.label


def test_gray_index_finds_all_links(monkeypatch):
    codes = clustered_codes()
    for held in (1 << 20, 64):  # also where searches have to be parted
        monkeypatch.setattr("casework.llm.gray_index.HELD", held)
        index, forest, rows = GrayIndex(codes), Forest(len(codes)), np.arange(len(codes))
        index.search(codes[index.order], 3, forest, index.order, rows)
        assert (forest.label == brute_labels(codes, 3)).all()


@pytest.mark.parametrize("node_size", [16_384, 4])
def test_links_across_tasks(spark, node_size):
    from casework.llm.components import components

    codes = clustered_codes(1)
    prints = spark.createDataFrame([(int(c), i) for i, c in enumerate(codes.view(np.int64))], "code long, node long")
    found = dict(components(hamming_links(prints, 3, node_size)).collect())
    labels = brute_labels(codes, 3)
    first = {label: min(np.flatnonzero(labels == label)) for label in np.unique(labels)}
    assert all(found.get(i, i) == first[label] for i, label in enumerate(labels))


def test_near_duplicates(spark, odd_texts, no_docs):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    found = {r["doc_id"]: r for r in QUERIES["op5_simhash"](spark, SMALL).collect()}
    codes = np.array([brute_print(r["text"], 3) for r in docs], np.uint64)
    labels = brute_labels(codes, 3)
    for i, row in enumerate(docs):
        assert found[row["doc_id"]]["fingerprint"] == f"{int(codes[i]):016x}"
        assert found[row["doc_id"]]["component_id"] == min(docs[j]["doc_id"] for j in np.flatnonzero(labels == labels[i]))
    odd = near_duplicates(odd_texts, words=3).collect()
    assert len(odd) == odd_texts.count()
    assert {r["component_id"] for r in odd if r["fingerprint"] == "0" * 16} == {1}
    assert near_duplicates(no_docs).count() == 0


def test_a_key_with_two_texts_links_nothing(spark):
    texts = {"A": "one two three four five six", "B": "quite another text of eight words that stands", "C": "nothing like the others here at all", "D": "one two three four five six"}
    rows = [(1, "A"), (2, "A"), (2, "B"), (3, "C"), (4, "B"), (5, "D"), (5, "D"), (6, "C"), (6, "C"), (None, "A"), (None, "A"), (3, "C")]
    docs = spark.createDataFrame([(k, texts[t], t, "x", 1) for k, t in rows], "doc_id long, text string, kept_key string, _text string, code int")
    found = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in near_duplicates(docs.where("doc_id is not null"), words=3).collect()}
    print_of = {t: f"{brute_print(x, 3):016x}" for t, x in texts.items()}
    assert found == {(k, print_of[t]): {"A": 1, "B": 2, "C": 3, "D": 1}[t] for k, t in rows if k}
    kept = without_near_duplicates(docs, words=3)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["kept_key"]) for r in kept.collect()) == [(0, "A"), (0, "A"), (1, "A"), (2, "B"), (3, "C")]


def test_kept_documents_against_brute_force(spark, odd_texts, no_docs):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    labels = brute_labels(np.array([brute_print(r["text"], 3) for r in rows], np.uint64), 3)
    first = {min(rows[j]["doc_id"] for j in np.flatnonzero(labels == label)) for label in np.unique(labels)}
    kept = without_near_duplicates(docs, words=3)
    assert kept.schema == docs.schema and sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(first)
    odd = without_near_duplicates(odd_texts, words=3)
    assert odd.where("doc_id is null").count() == 2 and odd.where("doc_id in (1, 2, 3)").count() == 1
    assert odd.where("doc_id = 5").count() == 0 and odd.where("doc_id = 4").count() == 1
    assert without_near_duplicates(no_docs).count() == 0
