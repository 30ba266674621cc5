"""Comment and submission dumps: files, schemas, typed projections, import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sharelens.functions.text import unescape_body
from sharelens.session import settle_small

# The dump schemas, by hand so that no pass over the data infers them.
SCHEMAS = {
    "comments": (
        "id STRING, parent_id STRING, score INTEGER, author_flair_css_class STRING, "
        "author_flair_text STRING, link_id STRING, author STRING, subreddit STRING, body STRING, "
        "edited INTEGER, gilded STRING, controversiality INTEGER, created_utc STRING, "
        "distinguished STRING"
    ),
    "submissions": (
        "author STRING, author_flair_css_class STRING, author_flair_text STRING, "
        "created_utc STRING, distinguished STRING, domain STRING, edited INTEGER, gilded STRING, "
        "id STRING, is_self BOOLEAN, over_18 BOOLEAN, score INTEGER, selftext STRING, "
        "title STRING, url STRING, subreddit STRING"
    ),
}
ID_PREFIX = {"comments": "t1_", "submissions": "t3_"}

# Fixed values: (file prefix, first month, last month, extension) of the monthly dumps.
MONTHLY_FILES = {
    "submissions": [
        ("RS_v2_", "2005-06", "2010-12", "xz"),
        ("RS_", "2011-01", "2014-12", "bz2"),
        ("RS_", "2015-01", "2016-12", "zst"),
        ("RS_", "2017-01", "2017-11", "bz2"),
        ("RS_", "2017-12", "2018-10", "xz"),
        ("RS_", "2018-11", "2019-12", "zst"),
    ],
    "comments": [
        ("RC_", "2005-12", "2017-11", "bz2"),
        ("RC_", "2017-12", "2018-09", "xz"),
        ("RC_", "2018-10", "2019-12", "zst"),
    ],
}
STUDY_START = "2015-01"

MAX_BROADCAST_USERS = 2_000_000


def _months(first: str, last: str) -> list[str]:
    year, month = map(int, first.split("-"))
    out = []
    while f"{year:04d}-{month:02d}" <= last:
        out.append(f"{year:04d}-{month:02d}")
        year, month = (year, month + 1) if month < 12 else (year + 1, 1)
    return out


def dump_files(kind: str, study_only: bool = False, year: str | None = None) -> list[str]:
    """Names of the monthly files, oldest first; the study period starts in 2015."""
    if kind not in MONTHLY_FILES:
        raise ValueError(f"unknown kind {kind}")
    return [
        f"{prefix}{month}.{extension}"
        for prefix, first, last, extension in MONTHLY_FILES[kind]
        for month in _months(first, last)
        if (not study_only or month >= STUDY_START) and (year is None or month.startswith(year))
    ]


def read_dump(spark: SparkSession, paths: list[str] | str, kind: str) -> DataFrame:
    """JSON lines of one kind, all files in one scan."""
    return spark.read.schema(SCHEMAS[kind]).option("encoding", "UTF-8").json(paths)


def with_file_month(df: DataFrame) -> DataFrame:
    """Month of the dump file a row came from."""
    name = F.col("_metadata.file_name")
    return df.withColumn("month", F.regexp_extract(name, r"(\d{4}-\d{2})", 1))


def _typed(name: str, kind: str) -> Column:
    return F.expr(f"try_cast({name} as {kind})").alias(name)


def _id_columns(kind: str) -> list[Column]:
    parent = F.lit(None) if kind == "submissions" else F.col("parent_id")
    return [
        F.concat(F.lit(ID_PREFIX[kind]), F.col("id")).alias("id"),
        parent.cast("string").alias("parent_id"),
    ]


def project_comments(df: DataFrame) -> DataFrame:
    columns = []
    for name, kind in [
        ("score", "int"), ("author_flair_css_class", "string"), ("author_flair_text", "string"),
        ("link_id", "string"), ("author", "string"), ("subreddit", "string"), ("body", "string"),
        ("edited", "int"), ("gilded", "string"), ("controversiality", "int"),
        ("created_utc", "int"), ("distinguished", "string"),
    ]:
        columns.append(unescape_body(F.col("body")).alias("body") if name == "body" else _typed(name, kind))
    return df.select(*_id_columns("comments"), *columns)


def project_submissions(df: DataFrame) -> DataFrame:
    columns = []
    for name, kind in [
        ("author", "string"), ("author_flair_css_class", "string"), ("author_flair_text", "string"),
        ("created_utc", "int"), ("distinguished", "string"), ("domain", "string"), ("edited", "int"),
        ("gilded", "string"), ("is_self", "boolean"), ("over_18", "boolean"), ("score", "int"),
        ("selftext", "string"), ("title", "string"), ("url", "string"), ("subreddit", "string"),
    ]:
        columns.append(
            unescape_body(F.col("selftext")).alias("selftext") if name == "selftext" else _typed(name, kind)
        )
    return df.select(*_id_columns("submissions"), *columns)


def project_objects(df: DataFrame, kind: str) -> DataFrame:
    """The short form shared by comments and submissions."""
    return df.select(
        *_id_columns(kind), _typed("created_utc", "int"), _typed("subreddit", "string"),
        _typed("author", "string"), _typed("score", "int"),
    )


def human_active(df: DataFrame, users: DataFrame) -> DataFrame:
    """Rows of authors that are no bots and active.

    The users are filtered and counted first. Up to ``MAX_BROADCAST_USERS`` they
    are broadcast and the rows stay where they were read; more are joined by
    shuffle, where Spark splits a hot author.
    """
    wanted = users.where(~F.col("is_bot") & F.col("is_active")).select(F.col("user").alias("author"))
    return df.join(settle_small(wanted, MAX_BROADCAST_USERS), "author", "left_semi")


def import_comments(df: DataFrame, users: DataFrame | None = None) -> DataFrame:
    return project_comments(df if users is None else human_active(df, users))


def import_all_objects(submissions: DataFrame, comments: DataFrame) -> DataFrame:
    return project_objects(submissions, "submissions").unionByName(project_objects(comments, "comments"))
