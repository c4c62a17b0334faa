from collections import Counter

from pyspark.sql import functions as F

from brute import edge_docs, edge_rows
from trueline.llm import langid
from trueline.llm.queries import op6_language_id


def test_edges(spark):
    docs = edge_docs(spark)
    model = langid.train(docs)
    assert model.languages == ["de", "en"]  # the French row has no word
    rows = langid.identify(docs.withColumn("key", F.coalesce("doc_id", F.lit(-1))), model, carry=("key",)).collect()
    assert len(rows) == len(edge_rows())
    pred = {r.key: (r.lang_pred, r.score) for r in rows}
    assert pred[3] == pred[4] == pred[5] == pred[6] == pred[12] == ("und", 0.0)
    assert pred[10][0] == pred[11][0] == "de" and pred[13][0] == "en"
    assert all(0 <= r.score <= 1 for r in rows)


def test_nothing_to_learn(spark):
    empty = edge_docs(spark, [])
    model = langid.train(empty)
    assert langid.identify(empty, model, carry=("doc_id",)).collect() == []
    pred = langid.identify(edge_docs(spark), model, carry=("doc_id",)).collect()
    assert {(r.lang_pred, r.score) for r in pred} == {("und", 0.0)}


def test_counts_equal_a_plain_count(spark):
    rows = [(k, f"Ein Haus, ein {'Baum' * (k % 3)} Straße", "de", None) for k in range(20)]
    got = {(r.lang, r.word): r.n for r in langid.word_counts(edge_docs(spark, rows)).collect()}
    want = Counter(("de", w) for _, t, *_ in rows for w in langid.WORD.findall(t.lower()))
    assert got == dict(want)


def test_backoff_takes_the_longest_known_order(spark):
    rows = [(1, "schloss schule schiff", "de", None), (2, "house street strong", "en", None)]
    model = langid.train(edge_docs(spark, rows))
    p = langid.Predictor(model)
    assert p.predict("schlumpf")[0] == "de" and p.predict("strolling")[0] == "en"
    assert model.backoff("qqqq") is None
    assert p.predict("qqqq 日本")[0] == "de"  # nothing known: a tie, the first language
    assert p.predict("x" * 100_000)[0] in ("de", "en")


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.001"
    rows = op6_language_id(spark, sf).join(
        spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 40
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)


def test_labels_of_held_out_rows_are_not_used(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    train = docs.where(~langid.held_out(F.col("doc_id")))
    spoilt = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    a = langid.train(train)
    b = langid.train(spoilt.where(~langid.held_out(F.col("doc_id"))))
    assert a.languages == b.languages and a.words == b.words


def test_every_entry_counts_whatever_the_cache_holds(spark, monkeypatch):
    """A small language beside a hot one with more words than the caches hold,
    hot unseen words, long runs and repeated rows."""
    hot = [(k, " ".join(f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"[:1 + k % 6]), "aa", None)
           for k in range(40)]
    run = "".join(chr(0x4E00 + 7 * k % 5000) for k in range(60))
    small = [(100, "ένα σπίτι δύο δέντρα τρία", "zz", None), (101, f"σπίτι {run}", "zz", None)]
    model = langid.train(edge_docs(spark, hot + small))
    texts = ["ένα σπίτι", "σπιτάκι", run[5:30], run, "bal dem", "bulz", "qqqq", "", None, "12", "ένα σπίτι"]
    texts += ["bulz δέντρα", "bulz"] * 50
    docs = edge_docs(spark, [(k, t, None, None) for k, t in enumerate(texts)]).withColumn("key", F.col("doc_id"))
    whole = {r.key: (r.lang_pred, r.score) for r in langid.identify(docs, model, carry=("key", "row")).collect()}
    assert len(whole) == len(texts)
    assert [whole[k][0] for k in range(6)] == ["zz", "zz", "zz", "zz", "aa", "aa"]
    for limits in ((0, 0), (20, 30), (1000, 30)):
        monkeypatch.setattr(langid, "WORD_LIMIT", limits[0])
        monkeypatch.setattr(langid, "GRAM_LIMIT", limits[1])
        model = langid.train(edge_docs(spark, hot + small))
        assert len(model.words) <= limits[0] and len(model.grams) <= limits[1]
        cached = langid.identify(docs, model, carry=("key", "row")).collect()
        assert len(cached) == len(texts)
        assert {r.key: (r.lang_pred, r.score) for r in cached} == whole


def plain_scorer(training, texts):
    """Predictions from dictionaries, entry by entry."""
    import math
    from collections import Counter, defaultdict
    words = defaultdict(Counter)
    for text, lang in training:
        words[lang].update(langid.WORD.findall(text.lower()))
    grams = defaultdict(Counter)
    for lang, c in words.items():
        for w, n in c.items():
            for order in (4, 3, 2, 1):
                for g in langid.grams(w, order):
                    grams[lang][g] += n
    languages = sorted(words)

    def table(counts):
        totals = Counter()
        for lang, c in counts.items():
            for e, n in c.items():
                totals[lang, len(e) if counts is grams else 0] += n
        out = {}
        for e in {e for c in counts.values() for e in c}:
            kind = len(e) if counts is grams else 0
            share = {lang: counts[lang][e] / totals[lang, kind] for lang in languages if counts[lang][e]}
            best = max(share.values())
            out[e] = [math.floor(math.log(share[lang] / best / langid.FLOOR + 1) * langid.UNIT + 0.5) if lang in share else 0
                      for lang in languages]
        return out

    of_word, of_gram = table(words), table(grams)
    out = []
    for text in texts:
        found = langid.WORD.findall(text.lower())
        total = [0] * len(languages)
        for w in found:
            if w in of_word:
                own = of_word[w]
            else:
                own = [0] * len(languages)
                for order in (4, 3, 2, 1):
                    known = [of_gram[g] for g in langid.grams(w, order) if g in of_gram]
                    if known:
                        own = [sum(x) // len(known) for x in zip(*known)]
                        break
            total = [a + b for a, b in zip(total, own)]
        z = [math.exp((t - max(total)) / (langid.UNIT * math.sqrt(len(found)))) for t in total]
        out.append((languages[total.index(max(total))], max(z) / sum(z)))
    return out


def test_equals_a_plain_scorer(spark, monkeypatch):
    """With caches that hold nearly nothing, so that the joins decide."""
    import random
    rng = random.Random(4)
    parts = {"aa": ["ka", "lo", "mi", "ste", "qu"], "bb": ["lo", "zer", "ung", "ka", "ö"], "cc": ["mi", "xo", "rr", "é"]}
    word = lambda lang: "".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4)))
    text = lambda lang: " ".join(word(lang) for _ in range(rng.randint(1, 30)))
    training = [(text(lang), lang) for lang in parts for _ in range(25)]
    texts = [text(rng.choice(list(parts))) + " " + "w" * rng.randint(0, 50) for _ in range(60)]
    monkeypatch.setattr(langid, "WORD_LIMIT", 12)
    monkeypatch.setattr(langid, "GRAM_LIMIT", 12)
    model = langid.train(spark.createDataFrame(training, "text string, lang string"))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, model, carry=("doc_id",)).collect()}
    for k, (lang, score) in enumerate(plain_scorer(training, texts)):
        assert got[k][0] == lang and abs(got[k][1] - score) < 1e-6
