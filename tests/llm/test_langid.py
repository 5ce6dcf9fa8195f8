import random

from pyspark.sql import functions as F

from motifloom.llm.langid import identify_language, learn_languages

SOUNDS = {"en": ["the", "and", "ing", "th", "wh", "ed"], "de": ["der", "sch", "ung", "ein", "ch", "ü"], "fr": ["les", "eau", "que", "é", "oi", "tion"]}


def corpus():
    rng = random.Random(9)
    rows = []
    for i in range(240):
        lang = rng.choice(sorted(SOUNDS))
        rows.append((i, " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(20, 120))), lang))
    return rows


def test_held_out_accuracy(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    model = learn_languages(docs, F.col("doc_id") % 5 != 0)
    out = identify_language(docs.withColumn("lang_score", F.lit("x")), model).collect()
    held = [r for r in out if r["doc_id"] % 5 == 0]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["lang_score"] <= 1 and not r["lang_rejected"] for r in held)


def test_odd_texts(spark, make_docs, texts):
    docs = spark.createDataFrame([*corpus(), (900, None, "xx"), (901, "some text", None), (902, "123", "xx")], "doc_id long, text string, lang string")
    model = learn_languages(docs, F.lit(True))
    assert sorted(model.names) == ["de", "en", "fr"]
    out = identify_language(make_docs([*texts, (77, "12 !? 3")], extra=True), model).collect()
    assert len(out) == len(texts) + 1
    for r in out:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and (letters or (r["lang_score"] == 0 and r["lang_rejected"]))
    assert identify_language(make_docs([]), model).count() == 0


def test_nothing_learnt(make_docs):
    docs = make_docs([(1, "abc")]).withColumn("lang", F.lit(None).cast("string"))
    model = learn_languages(docs, F.lit(True))
    assert identify_language(docs, model).first()["lang_pred"] == "und"


def test_copies_of_an_early_text_leave_the_dictionary_whole(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    early = docs.filter("lang = 'en'").orderBy(F.xxhash64("text", F.lit(7))).first()["text"]
    copies = spark.createDataFrame([(1000 + i, early, "en") for i in range(450)], "doc_id long, text string, lang string")
    model, more = learn_languages(docs, F.lit(True)), learn_languages(docs.unionAll(copies), F.lit(True))
    assert dict(zip(more.names, more.dictionaries, strict=True)) == dict(zip(model.names, model.dictionaries, strict=True))


def test_a_text_of_most_rows_leaves_no_dictionary_empty(spark):
    few = [(i, t, "en") for i, (_, t, lang) in enumerate(corpus() * 4) if lang == "en"][:300]
    german = " ".join(random.Random(3).choice(SOUNDS["de"]) for _ in range(200))
    docs = spark.createDataFrame([*few, *((1000 + i, german, "de") for i in range(6000))], "doc_id long, text string, lang string")
    model = learn_languages(docs, F.lit(True))
    assert model.names == ["de", "en"] and german.encode() in model.dictionaries[0]
    assert identify_language(docs.filter("doc_id = 1000"), model).first()["lang_pred"] == "de"


def test_texts_are_cut_anywhere(spark):
    rng = random.Random(8)
    long = " ".join(f"{rng.randrange(10**9):x}" for _ in range(20_000))
    model = learn_languages(spark.createDataFrame([(1, long, "xx")], "doc_id long, text string, lang string"), F.lit(True))
    assert model.dictionaries[0] in long.encode() and not long.encode().startswith(model.dictionaries[0])


def test_ties_go_to_the_language_with_more_rows(spark):
    docs = spark.createDataFrame([(1, "abc abc", "b"), (2, "abc abc", "a"), (3, "abc abc", "b")], "doc_id long, text string, lang string")
    row = identify_language(docs, learn_languages(docs, F.lit(True))).first()
    assert (row["lang_pred"], row["lang_score"], row["lang_rejected"]) == ("b", 0.0, True)
