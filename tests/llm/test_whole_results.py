"""Results that do not hang on the order of rows, on names of columns or on what a pattern takes for a letter."""

import random
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from casework.llm import language, toxicity
from casework.llm.embeddings import near_vectors
from casework.llm.mixing import mix
from casework.llm.packing import best_fit, pack
from casework.llm.passages import repeated_spans
from casework.llm.sampling import remainder
from casework.llm.simhash import near_duplicates, without_near_duplicates
from casework.llm.token_counts import token_counts
from conftest import SMALL
from odd_tables import workers  # noqa: F401  fixtures


def plain_best_fit(lengths, size, documents, attention, weights, select):
    """One open sequence after the other, for each piece from the longest on."""
    cap = np.array([size, documents, attention], float)
    open_, places = [], {}
    for at in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = np.array([lengths[at], 1.0, float(lengths[at]) ** 2])
        best = None
        for n, left in enumerate(open_):
            if (left >= need).all():
                score = -(left * need / cap**2 @ weights) if select == "dot" else (((left - need) ** 2) / cap**2 @ weights)
                if best is None or score < best[0] - 1e-12:
                    best = score, n
        if best is None:
            open_.append(cap.copy())
        n = best[1] if best else len(open_) - 1
        places[at] = n, size - int(open_[n][0])
        open_[n] = open_[n] - need
    return [places[i] for i in range(len(lengths))]


@pytest.mark.parametrize("select", ["norm", "dot"])
@pytest.mark.parametrize("size, documents, attention", [(100, 100, 1e4), (100, 3, 1e4), (100, 50, 4000.0)])
def test_best_fit_against_a_plain_loop(select, size, documents, attention):
    lengths = np.random.default_rng(documents).integers(1, 64, 250)
    sequence, offset = best_fit(lengths, size, documents, attention, select=select)
    expected = plain_best_fit(lengths, size, documents, attention, np.array([1.0, 0.05, 0.05]), select)
    assert list(zip(sequence.tolist(), offset.tolist())) == expected


def test_packing_does_not_depend_on_the_order_of_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert sorted(map(tuple, pack(docs).collect())) == sorted(map(tuple, pack(docs.orderBy(F.desc("doc_id")).repartition(7)).collect()))


def test_packed_sequences_follow_the_mixture(spark, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "STRETCH", 8)
    rows = [(i, "word " * (5 + i * 7 % 90), "a" if i % 4 else "b") for i in range(4000)] + [(9999, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("_name", F.lit("x"))
    packed = corpus_pipeline.best_fit_packing(spark, docs, SMALL)
    found = packed.join(docs.select("doc_id", "source"), "doc_id").orderBy("sequence_id").collect()
    total = Counter(r["source"] for r in found)
    assert total == {"a": 3000, "b": 1000, None: 1}
    # weights are sizes to a power; while both last, every run of 400 pieces has their shares
    share = 1000**0.9 / (1000**0.9 + 3000**0.9)
    runs = [found[i : i + 400] for i in range(0, 3200, 400)]
    assert all(abs(sum(r["source"] == "b" for r in run) / 400 - share) < 0.08 for run in runs)
    slots = {r["doc_id"]: r["mix_slot"] for r in mix(docs, temperature=corpus_pipeline.TEMPERATURE).collect()}
    by_sequence = defaultdict(list)
    for r in found:
        by_sequence[r["sequence_id"]].append(slots[r["doc_id"]])
    stretches = [{s // 8 for s in own} for _, own in sorted(by_sequence.items())]
    assert all(len(s) == 1 for s in stretches) and [min(s) for s in stretches] == sorted(min(s) for s in stretches)


def test_only_letters_make_a_word(spark):
    texts = ["² ½", "①②③", "Ⅷ ⅻ", "12 ٣ _", "a²", "日本", "ªº", "१२", "ǅ", "\U0001d400", "́", "x́", ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    taught = spark.createDataFrame([(1, "the cat", "en"), (2, "der hund", "de")], "doc_id long, text string, lang string")
    found = language.identify(docs, language.fit(taught, F.lit(True)))
    for r in found.collect():
        lettered = any(unicodedata.category(c).startswith("L") for c in r["text"])
        assert (r["lang_pred"] != "und") == lettered, r


def test_vectors_keep_their_precision(spark):
    rows = [(1, [1e200, 0.0]), (2, [1e200, 0.0]), (3, [0.0, 1e-50]), (4, [0.0, 2e-50]), (5, [-1e300, 1e300]), (6, [1.0, 0.33]), (7, [1.0, 0.0])]
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert found == {1: (2, 1), 2: (2, 1), 7: (2, 1), 3: (1, 3), 4: (1, 3), 5: (0, 5), 6: (0, 6)}


def test_texts_with_a_passage_in_common_all_teach(spark, monkeypatch):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    passage = " ".join(rng.choices(words, k=80))
    rows, labels = [], []
    for i in range(600):
        own = rng.choices(words, k=60)
        if i % 5 < 2:
            own[rng.randrange(60)] = rng.choice(["zzblarg", "zzfoomp"])
        rows.append((i, passage + " " + " ".join(own)))
        labels.append((i, int(i % 5 < 2)))
    rows += [(1000 + i, rows[0][1].upper()) for i in range(50)]  # copies of a toxic text, marked clean
    labels += [(1000 + i, 0) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    taught, keep = [], toxicity.written

    def written(df, name):
        out = keep(df, name)
        if name == "taught":
            taught.extend(out[0].collect())
        return out

    monkeypatch.setattr(toxicity, "written", written)
    learn = F.col("doc_id") < 1000
    model = toxicity.fit(docs, marks, F.lit(True), trees=3)
    assert len(taught) == 600 and {r["doc_id"]: r["label"] for r in taught}[0] == 1
    assert sum(r["weight"] for r in taught) > 550
    found = toxicity.toxicity(docs, model).join(marks, "doc_id").where(learn).collect()
    assert sum(r["predicted"] == r["toxic"] for r in found) / len(found) > 0.97


def test_calibration_rows_teach_nothing_else(spark, monkeypatch):
    counted, keep = [], toxicity.lexicon
    monkeypatch.setattr(toxicity, "lexicon", lambda rows, *n: counted.append((rows.where("later").count(), rows.count())) or keep(rows, *n))
    docs = spark.createDataFrame([(i, f"text number {i} {'bad' if i % 3 else 'good'} word{i * 7 % 50}") for i in range(300)], "doc_id long, text string")
    marks = spark.range(300).selectExpr("id as doc_id", "cast(id % 3 > 0 as int) as toxic")
    toxicity.fit(docs, marks, remainder("doc_id", 5) != 0, trees=2)
    assert counted and counted[0][0] == 0 and 0 < counted[0][1] < 240


def test_columns_of_any_name(spark):
    names = ["tag", "text_id", "_tag", "found", "_name", "_none", "_hash", "_range", "_number", "_before", "_within", "_n", "kept_key", "kept_digest", "spans", "mix_slot", "_text", "code"]
    texts = ["a b c " + "x" * 300, "d " + "x" * 300, "other words", None]
    rows = [(i, t, "en", "s", *([i] * len(names))) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` int" for n in names))
    spans = repeated_spans(docs)
    assert spans.columns == [*(c for c in docs.columns if c != "spans"), "spans"]
    assert {r["doc_id"]: (r["tag"], len(r["spans"])) for r in spans.collect()} == {0: (0, 1), 1: (1, 1), 2: (2, 0), 3: (3, 0)}
    mixed = mix(docs)
    assert set(docs.columns) <= set(mixed.columns) and all(r["_name"] == r["_hash"] == r["doc_id"] for r in mixed.collect())
    kept = without_near_duplicates(docs)
    assert kept.columns == docs.columns and all(r["_text"] == r["kept_key"] == r["doc_id"] for r in kept.collect())
    assert near_duplicates(docs).count() == pack(docs).select("doc_id").distinct().count() == 4
    assert mix(docs, source="_name").where("mix_slot is null").count() == 0


def test_other_vocabularies_are_refused(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    with pytest.raises(Exception, match="no byte-level BPE"):
        token_counts(docs, path=public_tokenizers.path("word_bpe_49k.json")).collect()
