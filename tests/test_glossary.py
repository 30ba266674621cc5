from sharelens.operators import glossary as ops


def names(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def test_lists_merge_without_duplicates(spark):
    merged = ops.merge_lists([names(spark, ["b", "A", None]), names(spark, ["b", "9x", ""])])
    assert {(r.id, r.first_letter) for r in merged.collect()} == {("b", "B"), ("A", "A"), ("9x", "0-9")}
    assert [r.id for r in ops.sorted_names(merged).collect()] == ["9x", "A", "b"]


def described(spark, ids):
    merged = ops.merge_lists([names(spark, ids)])
    meta = spark.createDataFrame([("a_b", "# 50% [x](http://y)"), ("abc", None)], "id string, description string")
    extra = spark.createDataFrame([("abc", "Subreddit forbidden"), ("a_b", "unused")], "id string, description string")
    return ops.with_description(merged, meta, extra)


def bins(spark):
    return spark.createDataFrame([("a_b", -2, 0, 3)], "id string, age int, gender int, partisan int")


def test_lines(spark):
    rows = ops.glossary_lines(described(spark, ["a_b", "abc"]), bins(spark)).orderBy("position").collect()
    assert rows[0].line == (
        r"\glossarytitle{a\_b}{gstd_age_n2}{gstd_gender_0}{gstd_partisan_3} \newline \glossarydesc{  50\% x}" + "\\\\"
    )
    assert rows[1].line == (
        r"\glossarytitle{abc}{gstd_age_0}{gstd_gender_0}{gstd_partisan_0} \newline "
        r"\glossarydesc{\textit{Community banned or deleted prior to publication}}&"
    )


def test_sections_close_even_letters(spark):
    lines = ops.glossary_lines(described(spark, ["a_b", "abc", "Bee"]), bins(spark))
    text = [r.line for r in ops.write_order(ops.glossary_sections(lines)).collect()]
    assert text[0] == r"\glossaryheader{A} &" and text[3] == r"\glossaryheader{B} &"
    assert text[2].endswith("&\\\\") and text[4].endswith("}\\\\") and not text[4].endswith("\\\\\\\\")


def test_descriptions(spark):
    pages = spark.createDataFrame([("h", '<meta name="description" content="d">'), ("g", "<p>")], "host string, html string")
    found = ops.page_descriptions(pages)
    assert {r.host: r.desc for r in found.collect()} == {"h": "d", "g": ""}
    hosts = spark.createDataFrame([("h",), ("z",)], "host string")
    assert {r.host: r.desc for r in ops.attach_descriptions(hosts, found).collect()} == {"h": "d", "z": None}
    assert [r.host for r in ops.drop_missing(found).collect()] == ["h"]
    words = spark.createDataFrame([("a",), ("b",)], "word string")
    assert ops.keep_words(words, words.where("word = 'a'")).count() == 1
