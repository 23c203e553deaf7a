"""Rows without ids by the thousand, copies under one id, and URLs of many steps."""

from pyspark.sql import functions as F

from relsift.llm import language_id, source_mix, url_filter

WORDS = {"en": "the house and this garden were with them", "de": "das Haus und dieser Garten waren mit ihnen",
         "es": "la casa y este jardín estaban con ellos"}


def unnamed(spark, n=3000):
    """``n`` distinct texts of three languages, none with an id."""
    rows = [(None, f"{WORDS[lang]} x{i}", lang, "s", 9) for i in range(n // 3) for lang in WORDS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size int")


def test_mix_deals_rows_without_id_to_many_buckets(spark):
    docs = unnamed(spark)
    part = source_mix._scattered(F.col("doc_id"), F.xxhash64("text")) % 64
    per = [r["count"] for r in docs.groupBy(part.alias("p")).count().collect()]
    assert len(per) == 64 and max(per) < 3 * 3000 / 64
    mixed = source_mix.mix_sources(docs)
    got = mixed.agg(F.sum("taken").alias("t"), F.max("target").alias("w"), F.count(F.lit(1)).alias("n")).first()
    assert got["n"] == 3000 and abs(got["t"] - got["w"]) <= 0.02 * got["w"]
    again = source_mix.mix_sources(docs.repartition(5))
    assert sorted(map(tuple, mixed.select("text_hash", "copies").collect())) == sorted(
        map(tuple, again.select("text_hash", "copies").collect()))


def test_language_sample_is_bounded_without_ids_and_with_copies(spark, monkeypatch):
    seen = []
    # the fit runs in a task, so its input is counted through the plan's own rows
    whole = language_id.fit_model

    def counted(x, langs):
        model = whole(x, langs)
        model.members = {**model.members, "rows": [str(len(langs))]}
        return model

    monkeypatch.setattr(language_id, "fit_model", counted)
    copies = spark.createDataFrame([(7, WORDS["en"], "en", "s", 9)] * 2000,
                                   "doc_id long, text string, lang string, source string, size int")
    for docs in (unnamed(spark), unnamed(spark).unionByName(copies)):
        model = language_id.train(docs, F.lit(True), sample_rows=300)
        seen.append(int(model.members.pop("rows")[0]))
    assert all(200 <= n <= 300 for n in seen)
    monkeypatch.undo()
    docs = unnamed(spark)
    model = language_id.train(docs, F.lit(True), sample_rows=300)
    named = docs.withColumn("doc_id", F.monotonically_increasing_id())
    wrong = language_id.identify(named, model).join(named.select("doc_id", "lang"), "doc_id").where("lang <> lang_pred")
    assert wrong.count() == 0


def test_url_of_a_megabyte_has_the_keys_of_a_short_one(spark):
    entries = spark.createDataFrame(
        [("long.com/a/a", "deep", "add", "2024-01-01"), ("long.com/a/b", "other", "add", "2024-01-01"), ("*.com", "tld", "add", "2024-01-01")],
        "pattern string, category string, action string, listed_at string").withColumn("listed_at", F.to_timestamp("listed_at"))
    urls = [(1, "http://long.com/" + "a/" * 500_000), (2, "http://long.com//A//b?q=1"), (3, "http://long.com/a"),
            (4, "http://else.org/" + "b/" * 500_000)]
    captures = spark.createDataFrame(urls, "page_id int, url string").withColumn("fetched_at", F.to_timestamp(F.lit("2024-05-01")))
    rows = {r["page_id"]: r for r in url_filter.filter_urls(captures, entries).collect()}
    assert {i: (r["pattern"], r["n_matches"]) for i, r in rows.items()} == {
        1: ("long.com/a/a", 2), 2: ("long.com/a/b", 2), 3: ("*.com", 1), 4: (None, 0)}


def license_oracle(docs):
    """The registered SQL over ``docs``, rows as tuples."""
    import duckdb

    from relsift.llm import queries
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"}))
    return con.execute(queries.ORACLE["op9_license_scan"]).fetchall()


def test_licenses_equal_sql_on_wrapped_hot_and_odd_rows(spark):
    import textwrap

    from relsift.llm import license_scan
    known = license_scan.SENTENCES
    mit = known["mit-1"] + "\n\n" + known["mit-2"]
    texts = [None, "", "...", mit, "\n".join(textwrap.wrap(mit, 30)), "\n".join(mit.split()), "the " * 3 + "\nsoftware\nthe\n\nsoftware",
             "# " + "\n# ".join(textwrap.wrap(known["agpl3-header-1"], 60)) + "\n#\n# " + known["agpl3-header-2"],
             known["isc-1"], known["0bsd-1"], "\n".join(textwrap.wrap(known["mpl2-1"] + " " + known["mpl2-2"], 40)),
             "\n".join(f"* {w}" for w in known["unlicense-1"].split()) + " " + known["unlicense-2"],
             "x. " + " ".join(["All rights reserved."] * 3000), "Permission to use, copy,\nmodify\nRedistribution and use\nin source"]
    texts += [f"SPDX-License-Identifier: {name}" for name in license_scan.SPDX]
    ids = list(range(len(texts))) + [None] * 600 + [3] * 600
    texts += ["\n".join(textwrap.wrap(mit, 50)), "All rights\nreserved."] * 300 + ["no licence", "Released under\nthe MIT License."] * 300
    docs = spark.createDataFrame([(i, t, 5, "x", 1) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, n int, sentence string, nth int")
    got = [tuple(r) for r in license_scan.scan_licenses(spark, docs.repartition(6)).collect()]
    key = lambda r: tuple((v is None, v or 0) if not isinstance(v, str) else (False, v) for v in r)
    assert sorted(got, key=key) == sorted(license_oracle(docs), key=key)
    by_id = {r[0]: r for r in got if r[0] is not None}
    assert [by_id[i][5] for i in (4, 5, 7, 8, 9, 10, 11)] == ["MIT", "MIT", "AGPL-3.0-or-later", "ISC", "0BSD", "MPL-2.0", "Unlicense"]
    assert by_id[12][1] == 3000 and by_id[3][1] == 302 and 6 not in by_id and 13 not in by_id
    assert sum(r[0] is None for r in got) == 600
