from pyspark.sql import functions as F

from foliolens.operators.markup import html_blocks
from foliolens.functions.register import register_functions
from foliolens.operators import exports
from foliolens.session import new_folder, shared_folder
from foliolens.sources import tables as T


def test_csv_round_trip(spark):
    rows = spark.createDataFrame([(1, 'say "hi", x'), (2, "line\nbreak")], "id int, text string")
    path = new_folder(spark, "csv")
    exports.sink_csv(rows, path)
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    assert sorted(map(tuple, back.collect())) == [("1", 'say "hi", x'), ("2", "line\nbreak")]


def test_results_round_trip_and_first_author(spark):
    path = new_folder(spark, "results")
    authors = spark.createDataFrame([("late",)], "name string")
    exports.sink_append(exports.as_results(authors, "author", "2024-01-02T00:00:00Z"), path)
    exports.sink_append(exports.as_results(authors.select(F.lit("early").alias("name")), "author", "2024-01-01T00:00:00Z"), path)
    exports.sink_append(exports.as_results(spark.range(3).toDF("n"), "article", "2024-01-01T00:00:00Z"), path)
    stored = T.scan_results(spark, path)
    assert T.article_results(stored).count() == 3
    first = T.first_author(stored).select(F.variant_get("data", "$.name", "string")).first()[0]
    assert first == "early"


def test_html_rows_and_json(spark):
    path = new_folder(spark, "html")
    article = spark.sql(
        "select 1 as article_id, 'a<b' as title, 'n' as author, 'u' as url, array('x','y') as tags, 1L as claps, 2L as responses, true as is_premium, timestamp'2024-01-01' as published_at"
    )
    exports.sink_html_rows(exports.html_report_row(article), path)
    assert spark.read.text(path).first()[0].startswith("<tr><td>a&lt;b</td><td>n</td><td>2024-01-01T00:00:00.000Z</td><td>0")
    exports.sink_json(article.withColumn("missing", F.lit(None).cast("string")), path + "-json")
    assert '"missing":null' in spark.read.text(path + "-json").first()[0]


def test_missing_fields_have_defaults(spark):
    article = spark.sql("select 'u' as url, cast(null as string) as title, 'n' as author, array('x') as tags, cast(null as bigint) as claps, 2L as responses, cast(null as boolean) as is_premium, cast(null as timestamp) as published_at")
    row = exports.export_rows(article, "now").first()
    assert len(row) == 24
    assert (row["Article Title"], row["Claps"], row["Is Premium"], row["Paywall Type"], row["Content Summary"]) == ("", 0, "No", "none", "")


def test_many_comments_are_split_but_whole(spark):
    comments = spark.range(2500).select(
        F.lit(1).alias("article_id"), F.col("id").alias("index"), F.lit("a").alias("author"), F.lit("c").alias("content"), F.lit(0).alias("claps")
    )
    rows = exports.public_comments(comments).select("comments_part", F.size("comments").alias("n")).collect()
    assert sorted(map(tuple, rows)) == [(0, 1000), (1, 1000), (2, 500)]


def test_shared_folder_is_the_named_one(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_nested_lists(spark):
    html = "<ul><li>a<ul><li>b</li></ul></li><li>c</ul><ol><li>d</ol>"
    rows = html_blocks(spark.createDataFrame([(1, html), (2, None)], "page_id bigint, html string")).collect()
    assert [tuple(r)[1:] for r in sorted(rows)] == [(0, 1, "ul", "a"), (1, 2, "ul", "b"), (2, 1, "ul", "c"), (3, 1, "ol", "d")]


def test_sql_functions(spark):
    names = register_functions(spark)
    assert len(names) == 15
    row = spark.sql(
        "select fl_hashtags('#A b'), fl_domain('https://WWW.Ex.com/a'), fl_is_valid_url('nope'), fl_digits_count('12,345'), "
        "fl_contains_ci_either('x','y'), fl_csv_escape('a\"b'), fl_html_escape('<\\'\">'), fl_estimate_minutes('a b', 1), fl_file_slug('..A b.')"
    ).first()
    assert tuple(row) == (["#a"], "ex.com", False, 12345, False, 'a""b', "&lt;&#39;&quot;&gt;", 2, "a_b")
