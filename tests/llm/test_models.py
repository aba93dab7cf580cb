import numpy as np
from pyspark.sql import functions as F

from answerscope.llm import language_id, quality_rules, toxicity
from answerscope.llm._common import in_fold
from answerscope.llm.queries import QUERIES


def test_toxicity_held_out(spark, tmp_path):
    """Insults mark toxic texts; unseen forms of a known stem count too."""
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("abcdef"), 3))
    rows = []
    for k in range(600):
        t = [word() for _ in range(40)]
        if k % 5 == 0:
            t[3], t[20], t[30] = "scum", "idiot", "vilelo" + word()[:1]
        rows.append((k, " ".join(t), int(k % 5 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    held = in_fold(F.col("doc_id"), 5, 0)
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"), ~held)
    got = toxicity.score(df, model).join(df, "doc_id").where(held).toPandas()
    assert (got["predicted"] == got["toxic"]).mean() > 0.97
    assert got["score"].between(0, 1).all()


def test_toxicity_learns_from_all_labelled_texts(spark):
    """A word of ordinary texts only is known, though few of as many texts as are toxic would have it."""
    rows = [(k, f"plain words here {'scum idiot' if k % 11 == 0 else 'good day'} {'seldom' if k % 7 == 1 else 'often'} said", int(k % 11 == 0)) for k in range(440)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = df.select("doc_id", "toxic")
    own = toxicity.labelled(labels.union(labels), F.col("doc_id") != 3)
    assert own.count() == 439 and own.where("toxic = 1").count() == 40
    model = toxicity.fit(df.select("doc_id", "text"), labels, F.lit(True))
    assert "seldom" in model.words and "scum" in model.words


def test_calibration_is_the_maximum_of_the_penalised_likelihood(spark):
    rng = np.random.default_rng(2)
    n = rng.integers(5, 60, 500)
    total, telling = rng.normal(0, 3, 500), rng.normal(0, 1, 500)
    toxic = (total + rng.normal(0, 2, 500) > 1).astype(int)
    rows = [(m, int(toxic[k]), float(total[k] * (m + 1)), float(telling[k]), float(n[k])) for m in (0, 1) for k in range(500)]
    models = [toxicity.Model.__new__(toxicity.Model) for _ in (0, 1)]
    for m in models:
        m.weights = np.zeros(5)
    losses = toxicity.calibrate(spark.createDataFrame(rows, "model int, toxic int, total double, telling double, n double").repartition(5), models)
    for k, m in enumerate(models):
        sums = np.stack([total * (k + 1), telling, n], 1)
        p = m.score(sums)
        assert np.allclose(m.features(sums).T @ (toxic - p), 1e-2 * m.weights, atol=1e-5)
        assert np.isclose(losses[k], -np.where(toxic == 1, np.log(p), np.log(1 - p)).mean())


def test_calibration_takes_few_passes(spark):
    """Nearly separable sums need large weights: each pass is a Spark job over all held texts, so there must be few."""
    rng = np.random.default_rng(3)
    n, toxic = rng.integers(50, 400, 600), rng.random(600) < 0.2
    total, telling = rng.normal(0, 3, 600), np.where(toxic, 4.0, 0.5) + rng.normal(0, 0.8, 600)
    rows = [(0, int(toxic[k]), float(total[k]), float(telling[k]), float(n[k])) for k in range(600)]
    model = toxicity.Model.__new__(toxicity.Model)
    model.weights = np.zeros(5)
    sums = spark.createDataFrame(rows, "model int, toxic int, total double, telling double, n double").coalesce(1).cache()
    sums.count()
    before, get = [0], type(sums).mapInArrow

    def counted(self, *args, **kwargs):
        before[0] += 1
        return get(self, *args, **kwargs)

    type(sums).mapInArrow = counted
    try:
        toxicity.calibrate(sums, [model])
    finally:
        type(sums).mapInArrow = get
    x = np.stack([total, telling, n], 1)
    assert np.allclose(model.features(x).T @ (toxic - model.score(x)), 1e-2 * model.weights, atol=1e-5)
    assert np.abs(model.weights).max() > 20 and before[0] <= 25


def test_models_keep_only_bigrams_with_something_left():
    """What a discount takes whole is the lower order's, and the sums are those of the formula over all bigrams."""
    rng = np.random.default_rng(5)
    words = {f"w{k}": k + 2 for k in range(30)}
    size = len(words) + 2
    pair = np.sort(rng.choice(size * size, 300, replace=False))
    counts = rng.integers(0, 60, (300, 2)).astype(float)
    of, types = np.zeros((size, 2)), np.zeros((size, 2))
    np.add.at(of, pair // size, counts)
    np.add.at(types, pair % size, (counts > 0).astype(float))
    m = toxicity.Model(words, pair, counts, types, of, np.zeros((4, 2)), 40.0, 2.0)
    left = np.maximum(counts - 40, 0)
    assert m.pair.tolist() == pair[left.any(1)].tolist() and len(toxicity.Model(words, pair, counts, types, of, np.zeros((4, 2)), 1000.0, 2.0).pair) == 0
    weight = [1 - np.bincount(pair // size, weights=left[:, c], minlength=size) / np.maximum(of[:, c], 1) for c in (0, 1)]
    assert np.allclose(m.left_back, np.log(weight[1]) - np.log(weight[0]), atol=1e-5)


def test_every_bigram_and_frequent_word_counts(spark):
    """Bigrams seen once are in the model, and scores are the same where the bigrams are joined instead of taken along."""
    rng = np.random.default_rng(7)
    rows = [(k, " ".join(f"w{i}x" if k % 3 else f"w{i}y" for i in rng.integers(0, 40, 30)), int(k % 3 == 0)) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3).cache()
    docs, labels = df.select("doc_id", "text"), df.select("doc_id", "toxic")
    model, joined = (toxicity.fit(docs, labels, F.lit(True), min_count=5, settings=toxicity.SETTINGS[:1], broadcast=n) for n in (2_000_000, 0))
    seen = {}
    held = {r["doc_id"] for r in toxicity.labelled(labels, F.lit(True)).where("held").collect()}
    for k, text, toxic in rows:
        if k not in held:
            x = [toxicity.START, *(toxicity.unit_of(model.words, w) for w in text.split())]
            for a, b in zip(x, x[1:]):
                seen.setdefault(a * model.size + b, [0, 0])[toxic] += 1
    pair = np.array(sorted(seen))
    counts = np.array([seen[p] for p in pair], float)
    assert (counts.sum(1) == 1).any() and model.pair.tolist() == pair.tolist()
    of, types = np.zeros((model.size, 2)), np.zeros((model.size, 2))
    np.add.at(of, pair // model.size, counts)
    np.add.at(types, pair % model.size, (counts > 0).astype(float))
    n = np.array([[(counts[:, c] == k).sum() for c in (0, 1)] for k in (1, 2, 3, 4)], float)
    want = toxicity.Model(model.words, pair, counts, types, of, n)
    assert np.allclose(model.ratio, want.ratio, atol=1e-4) and np.allclose(model.left_back, want.left_back, atol=1e-4)
    assert joined.bigrams and not len(joined.pair)
    a, b = ({r["doc_id"]: r["score"] for r in toxicity.score(docs, m).collect()} for m in (model, joined))
    assert len(a) == len(b) == 200 and all(abs(a[k] - b[k]) < 1e-4 for k in a)


def test_the_model_comes_to_the_driver_as_columns(spark, small):
    """Rows are Python objects: as rows, a model at its bounds took more memory than the driver has."""
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    kind, rows = type(docs), []
    get = kind.collect

    def counted(self):
        out = get(self)
        rows.append(len(out))
        return out

    kind.collect = counted
    try:
        model = toxicity.fit(docs.select("doc_id", "text"), labels, F.lit(True))
    finally:
        kind.collect = get
    assert len(model.words) > 1000 and max(rows) <= 100


def test_kneser_ney_equals_hand_computed_probabilities():
    """Two units a and b; the ratios are those of the interpolated formula, written out."""
    size, words = 4, {"a": 2, "b": 3}
    pair = np.array([1 * size + 2, 2 * size + 3, 3 * size + 2])
    counts = np.array([[2.0, 1.0], [4.0, 0.0], [1.0, 3.0]])
    types = np.array([[0, 0], [0, 0], [2, 2], [1, 0]], float)
    of = np.array([[0, 0], [2, 1], [4, 0], [1, 3]], float)
    d, low = 0.5, 0.75
    m = toxicity.Model(words, pair, counts, types, of, np.zeros((4, 2)), d, low)
    shared = np.array([0.5, 0.5, 4.5, 1.5]) / 7

    def lower(c, w):
        total = types[:, c].sum()
        return max(types[w, c] - low, 0) / total + np.minimum(types[:, c], low).sum() / total * shared[w]

    def p(c, n, h, kinds, w):
        return max(n - d, 0) / of[h, c] + d * kinds / of[h, c] * lower(c, w)

    want = [np.log(p(1, 1, 1, 1, 2) / p(0, 2, 1, 1, 2)), np.log(lower(1, 3) / p(0, 4, 2, 1, 3)), np.log(p(1, 3, 3, 1, 2) / p(0, 1, 3, 1, 2))]
    assert np.allclose(m.ratio, want, atol=1e-5)
    for c in (0, 1):  # the lower order is a distribution
        assert np.isclose(sum(lower(c, w) for w in range(size)), 1)
    assert np.allclose(toxicity.closed_form(np.array([100, 40, 20, 10])), [0, 1 - 2 * (100 / 180) * 0.4, 2 - 3 * (100 / 180) * 0.5, 3 - 4 * (100 / 180) * 0.5])


def test_toxicity_odd_rows(odd, empty, labels):
    model = toxicity.fit(odd, labels, F.lit(True))
    for m in (model, None):
        got = toxicity.score(odd, m).collect()
        assert len(got) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
        assert toxicity.score(empty, m).count() == 0
    assert toxicity.fit(empty, labels, F.lit(True)) is None and toxicity.fit(odd, labels.where("false"), F.lit(True)) is None


def test_language_held_out(spark, small):
    got = QUERIES["op5_language_id"](spark, small)
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang")
    r = got.join(docs, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.min("score"), F.max("score")).first()
    assert r[0] > 0.97 and r[1] >= 0 and r[2] <= 1


def test_language_mixture_and_odd_rows(spark, small, odd, empty):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.fit(docs, F.lit(True))
    text = {x["lang"]: x["text"] for x in docs.groupBy("lang").agg(F.max_by("text", F.length("text")).alias("text")).collect()}
    words = lambda k, n: text[k].lower().split()[:n]
    table = language_id.Words(model)
    x, n = table.rows([words("en", 300) + words("de", 100), words("fr", 200)])
    theta, size = language_id.infer(table.table[x], n)
    share = dict(zip(model.langs, theta[0]))
    assert 0.6 < share["en"] < 0.9 and 0.1 < share["de"] < 0.4 and size.tolist() == [2, 1] and theta[1].max() == 1
    for m in (model, None):
        got = {r["doc_id"]: r for r in language_id.predict(odd, m).collect()}
        assert [got[k]["lang_pred"] for k in (4, 5, 6, 8)] == ["und"] * 4 and got[4]["score"] == 0
        assert language_id.predict(empty, m).count() == 0
    kept = language_id.keep_known(odd, model)
    assert kept.columns == odd.columns and kept.where("doc_id in (4, 5, 6, 8)").count() == 0 and kept.where("doc_id = 1").count() == 1
    assert language_id.fit(empty, F.lit(True)) is None


def test_texts_in_no_learned_language_go(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.fit(docs, ~in_fold(F.col("doc_id"), 4, 2))
    other = ["Это совсем другой язык, которого модель не видела никогда раньше.", "Αυτή είναι μια άλλη γλώσσα που το μοντέλο δεν έχει δει.", "これはモデルが見たことのない言語です。", "xqzj wvkq zzxk qqjw kxzv jjqk"]
    foreign = spark.createDataFrame([(-1 - k, t, "x") for k, t in enumerate(other)], docs.schema)
    kept = {r["doc_id"] for r in language_id.keep_known(docs.unionByName(foreign), model).select("doc_id").collect()}
    assert not {k for k in kept if k < 0}
    held = [r["doc_id"] for r in docs.where(in_fold(F.col("doc_id"), 4, 2) & (F.length("text") > 200)).select("doc_id").collect()]
    assert sum(k in kept for k in held) >= 0.995 * len(held)


def plain_em(like, langs, rounds=2000):
    """Proportions of the given languages by plain expectation-maximisation, and the log-likelihood."""
    p = np.exp(like[:, langs] - like.max(1, keepdims=True))
    theta = np.full(len(langs), 1 / len(langs))
    for _ in range(rounds):
        w = theta * p
        theta = (w / w.sum(1, keepdims=True)).mean(0)
    return theta, np.log((theta * p).sum(1)).sum() + like.max(1).sum()


def test_mixtures_equal_plain_em_over_all_sets():
    """The selected set has the least criterion of all sets of languages, and its proportions are those of plain EM."""
    from itertools import combinations

    rng = np.random.default_rng(4)
    same, off = 0, []
    for case in range(60):
        k, n = 4, int(rng.integers(20, 200))
        true = rng.permutation([0.7, 0.3, 0, 0] if case % 3 else [1.0, 0, 0, 0])
        lang = rng.choice(k, n, p=true)
        like = rng.normal(-12, 1.0, (n, k)).astype(np.float32)
        like[np.arange(n), lang] += 5
        theta, size = language_id.infer(like, np.array([n]))
        fits = {s: plain_em(like.astype(float), list(s)) for m in range(1, k + 1) for s in combinations(range(k), m)}
        best = min(fits, key=lambda s: -2 * fits[s][1] + (len(s) - 1) * np.log(n))
        same += set(np.flatnonzero(theta[0] > 0)) == set(best)
        want = np.zeros(k)
        want[list(best)] = fits[best][0]
        off.append(np.abs(theta[0] - want).max())
        assert theta[0].argmax() == want.argmax() and size[0] == (theta[0] > 0).sum()
    assert same >= 57 and np.median(off) < 0.01 and max(off) < 0.1


def test_op1_tells_held_out_documents_apart(spark):
    small = "/root/testdata/sf0.1"  # sf0.01 has 40 toxic rows to learn from, too few
    got = QUERIES["op1_toxicity"](spark, small).toPandas()
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet").where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.5)).all()
    known = got.merge(labels, on="doc_id")
    known = known[known["held_out"]].sort_values("score")
    rank, toxic = np.arange(len(known)), known["toxic"].to_numpy() == 1
    assert (rank[toxic].mean() - (toxic.sum() - 1) / 2) / (~toxic).sum() > 0.9  # area under the curve


def brute_counts(text):
    import re
    from collections import Counter

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i, k in enumerate(zip(w, w[1:], w[2:])) if n[k] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in quality_rules.SYMBOLS for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_equal_brute_force(spark, small, odd, empty, labels):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    for df in (docs, odd):
        for r in quality_rules.text_statistics(df).collect():
            assert tuple(r[n] for n in names) == brute_counts(r["text"])
            assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
    rules = quality_rules.learn(odd, labels)
    got = quality_rules.apply(odd, rules)
    assert got.count() == odd.count() and quality_rules.apply(empty, rules).count() == 0
    assert got.where("kept and base_failed").count() == 0
    assert quality_rules.learn(empty, labels) == [] and quality_rules.learn(odd, labels.where("false")) == []


def test_extra_columns_are_kept(odd):
    extra = odd.withColumn("n_words", F.lit(9))
    got = quality_rules.apply(extra, [])
    assert {(r["rule_in"], r["kept_in"], r["n_words_in"]) for r in got.collect()} == {("x", "x", 9)}
    kept = quality_rules.keep(extra, [])
    assert kept.columns == extra.columns and sorted(map(repr, kept.collect())) == sorted(map(repr, extra.where("doc_id = 10 and false").collect()))
    long = extra.withColumn("text", F.expr("array_join(transform(sequence(1, 60), k -> concat('w', k)), ' ')"))
    assert sorted(map(repr, quality_rules.keep(long, []).collect())) == sorted(map(repr, long.collect()))


def test_a_repeated_id_is_learned_from_once(spark, labels):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(500)] + [(2, "x"), (None, "y"), (7, None)], "doc_id long, text string")
    assert isinstance(quality_rules.learn(docs, labels), list)


def test_filters_do_not_repeat_the_windows(spark, odd):
    """The verdict as a filter must not copy the arrays into it."""
    for df in (quality_rules.apply(odd, []).where("kept"), quality_rules.keep(odd, [])):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 4


def test_covering_finds_a_conjunction():
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(900):
        x = rng.random(len(quality_rules.FEATURES))
        rows.append((tuple(x), bool(x[2] > 0.6 and x[6] < 0.4)))
    rules = quality_rules.cover(rows)
    assert rules and {c.feature for c in rules[0].conditions} == {quality_rules.FEATURES[2], quality_rules.FEATURES[6]}
    assert np.mean([any(r.holds(x) for r in rules) == y for x, y in rows]) > 0.95
