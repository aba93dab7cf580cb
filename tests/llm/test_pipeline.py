import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from answerscope.llm import language_id, packing, quality_rules
from answerscope.llm._common import in_fold

from .test_models import brute_counts
from .test_near_dedup import brute
from .test_tokens import check_packed


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, small, odd, empty, name):
    """Nulls, empty and very long texts, repeated rows, clashing names and empty tables."""
    stage = dict(corpus_pipeline.STAGES)[name]
    extra = odd.withColumns({c: F.lit("x") for c in ("n_words", "lang_pred", "digest", "sequence_id", "length", "offset", "piece")})
    given = extra
    if name == "language_id":  # among documents, so that there is a language to learn
        docs = spark.read.parquet(f"{small}/documents.parquet").select((F.col("doc_id") + 10**6).alias("doc_id"), "text", "lang", "source")
        given = extra.unionByName(docs, allowMissingColumns=True)
    got = stage(spark, given, small).where("doc_id is null or doc_id < 1000000").collect()
    ids = sorted((r["doc_id"] for r in got if r["doc_id"] is not None))
    assert stage(spark, extra.where("false"), small).count() == 0
    if name == "packing":
        assert check_packed(got, 2048) and {r["doc_id"] for r in got} == {1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, None} and ids.count(13) == 2
        return
    assert set(got) <= set(extra.collect())  # the columns as they are
    if name == "quality_rules":
        assert ids == [] or ids == [9]
    if name == "language_id":
        assert not {4, 5, 6, 8} & set(ids) and {1, 2, 3} <= set(ids) and ids.count(13) in (0, 2)
    if name == "near_dedup":
        assert ids == [1, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13] and len(got) == 12


def plain_verdict(text, rules):
    """The base rule and the learned list, from counts by plain Python."""
    text = text or ""
    n, chars, symbols, dup, repeat = brute_counts(text)
    lines = max(1, sum(bool(x.strip(" \t\n\x0b\x0c\r")) for x in text.split("\n")))
    share = lambda test: sum(map(test, text))
    w, c = max(n, 1), max(chars, 1)
    row = (n, chars / w, symbols / w, share(lambda x: "A" <= x <= "Z") / c, share(lambda x: x in "!?") / w, share(lambda x: "0" <= x <= "9") / c, dup / lines, repeat / w, n / lines)
    return not (n < 50 or 100 * repeat > 50 * n or any(r.holds(row) for r in rules))


def plainly_likely(text, model):
    """Whether the mean log-likelihood of the trigrams of a text, word by word, reaches some language's floor."""
    words = [w for w in language_id.words_of(text) if language_id.of_letters(w)]
    means = sum(model.of_words([w])[0].astype(float) for w in words) / max(1, sum(len(w.encode()) for w in words))
    return not words or bool((means >= model.floor).any())


def test_pipeline_equals_stagewise_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    rules = quality_rules.learn(docs, labels)
    verdicts = {r["doc_id"]: plain_verdict(r["text"], rules) for r in docs.select("doc_id", "text").collect()}
    kept = docs.where(F.col("doc_id").isin([k for k, v in verdicts.items() if v]))
    model = language_id.fit(kept, ~in_fold(F.col("doc_id"), 4, 2))
    likely = {r["doc_id"] for r in kept.select("doc_id", "text").collect() if plainly_likely(r["text"], model)}
    known = {r["doc_id"] for r in language_id.predict(kept, model).collect() if r["lang_pred"] != "und" and r["score"] >= 0.34 and r["doc_id"] in likely}
    rows = [(r["doc_id"], r["text"]) for r in kept.select("doc_id", "text").collect() if r["doc_id"] in known]
    stay = {i for i, (_, c) in brute(rows, 5, 80).items() if i == c}
    got = corpus_pipeline.run(spark, small).collect()
    assert {r["doc_id"] for r in got} == stay
    total = sum(r["length"] for r in got)
    assert check_packed(got, 2048) <= int(np.ceil(total / 2048)) + 2
    enc = packing.tokenizer(P.path("byte_bpe_50k.json"), P.PATTERN)
    assert total == sum(len(enc.encode(t or "")) + 1 for i, t in rows if i in stay)
    clean = labels.where("quality = 1 and toxic = 0").join(docs.where(F.length("text") > 1000), "doc_id").select("doc_id").collect()
    assert np.mean([verdicts[r["doc_id"]] for r in clean]) > 0.95
