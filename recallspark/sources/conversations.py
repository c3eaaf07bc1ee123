"""Transcripts, chat exports and channel messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import fixed
from ..functions.text import natural_id, strip
from ..operators.scale import top_per_group
from .lines import numbered_lines
from .notes import file_name


# -- transcripts -----------------------------------------------------------------


def is_speech(line: Column) -> Column:
    """False for caption headers, counters, timestamps and blank lines."""
    return ((line != "") & (line != "WEBVTT") & ~line.rlike(r"^\d+$") & ~line.rlike(fixed.CAPTION_TIME_PATTERN))


def speaker_of(line: Column) -> Column:
    name = strip(F.regexp_extract(line, fixed.SPEAKER_PATTERN, 1))
    return F.when(name != "", name)


def is_name(name: Column) -> Column:
    return name.isNotNull() & ~F.upper(name).isin(fixed.SPEAKER_RESERVED)


def speech_lines(lines: DataFrame) -> DataFrame:
    """(id, line_no, line, speaker) of the spoken lines."""
    clean = lines.withColumn("line", strip(F.col("line"))).where(is_speech(F.col("line")))
    return clean.withColumn("speaker", speaker_of(F.col("line")))


def speaker_counts(lines: DataFrame) -> DataFrame:
    """(id, speaker, n, first_line)."""
    return (speech_lines(lines).where(is_name(F.col("speaker"))).groupBy("id", "speaker")
            .agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first_line")))


def parse_transcript(lines: DataFrame) -> DataFrame:
    """(id, people, speaker_lines): speakers by number of lines, ties by first appearance."""
    counts = speaker_counts(lines)
    order = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "first_line", "speaker")))
    people = counts.groupBy("id").agg(F.transform(order, lambda s: s["speaker"]).alias("people"))
    total = speech_lines(lines).groupBy("id").agg(F.count("speaker").alias("speaker_lines"))
    return (total.join(people, "id", "left")
            .withColumn("people", F.coalesce("people", F.array().cast("array<string>"))))


def detect_transcript(parsed: DataFrame) -> DataFrame:
    """Two speakers and three speaker lines, or a telling path when there is one."""
    by_text = (F.size("people") >= 2) & (F.col("speaker_lines") >= 3)
    by_path = telling_path(F.col("path")) if "path" in parsed.columns else F.lit(False)
    return parsed.withColumn("is_transcript", by_text | by_path)


def telling_path(path: Column) -> Column:
    low = F.lower(path)
    out = F.lit(False)
    for word in fixed.TRANSCRIPT_PATH_WORDS:
        out = out | F.contains(low, F.lit(word))
    return out


def spoken_text(c: Column) -> Column:
    lines = F.transform(F.split(c, r"\R"), strip)
    return F.filter(lines, is_speech)


def speakers_in(lines: Column) -> Column:
    """Speakers of one text, most lines first, inside the row."""
    names = F.filter(F.transform(lines, speaker_of), is_name)
    ranked = F.transform(F.array_distinct(names), lambda n: F.struct(
        (-F.size(F.filter(names, lambda x: x == n))).alias("n"), F.array_position(names, n).alias("at"), n.alias("name")))
    return F.transform(F.array_sort(ranked), lambda s: s["name"])


# -- chat exports -------------------------------------------------------------------


def parse_chat_log(lines: DataFrame) -> DataFrame:
    """(chat, seq, date, author, message). Lines of another form and system notices are left out."""
    line = F.col("line")
    part = lambda i: F.regexp_extract("line", fixed.CHAT_LINE_PATTERN, i)
    year = F.when(F.length(part(3)) == 4, part(3)).otherwise(F.concat(F.lit("20"), part(3)))
    system = part(6).rlike("|".join(rf"\Q{mark}\E" for mark in fixed.CHAT_SYSTEM_MARKERS))
    ok = lines.withColumn("line", strip(line)).where(F.col("line").rlike(fixed.CHAT_LINE_PATTERN) & ~system)
    day = F.try_to_date(F.concat_ws("-", year, part(2), part(1)), "yyyy-M-d")
    return ok.select("chat", "seq", day.alias("date"), strip(part(5)).alias("author"),
                     strip(part(6)).alias("message")).where("date is not null")


def scan_chat(spark: SparkSession, path: str) -> DataFrame:
    """(chat, seq, line, path) of exported chat files of any size; the chat is named after the file."""
    name = F.regexp_extract(file_name(F.col("path")), r"^(?:Chat(?: |%20)de(?: |%20)WhatsApp(?: |%20)con(?: |%20))?(.*)\.txt$", 1)
    return numbered_lines(spark, path).select(F.url_decode(name).alias("chat"), "seq", "line", "path")


def parse_slack_messages(messages: DataFrame, users: DataFrame) -> DataFrame:
    """(chat, seq, date, author, message); texts that are empty or have a subtype are left out."""
    kept = messages.withColumn("message", strip(F.coalesce("text", F.lit("")))).where(
        "message <> '' and coalesce(subtype, '') = ''")
    names = users.select(F.col("id").alias("user"), F.coalesce(
        F.when(F.col("real_name") != "", F.col("real_name")), "name", F.lit("?")).alias("known"))
    return (kept.join(names, "user", "left")
            .select("chat", "seq", "date", F.coalesce("known", "user", F.lit("?")).alias("author"), "message"))


def scan_slack(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(messages, users) of an unpacked export: ``<channel>/<date>.json`` and ``users.json``."""
    schema = "type string, subtype string, user string, text string, ts string"
    raw = (spark.read.schema(schema).option("multiLine", "true").option("pathGlobFilter", "[0-9]*.json")
           .json(f"{root}/*/").select("*", F.col("_metadata.file_path").alias("path")))
    messages = raw.select(
        F.element_at(F.split("path", "/"), -2).alias("chat"), F.col("ts").cast("double").alias("seq"),
        F.try_to_date(F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2})\.json$", 1), "yyyy-MM-dd").alias("date"),
        "user", "text", "subtype").where("date is not null")
    users = (spark.read.schema("id string, name string, profile struct<real_name:string>").option("multiLine", "true")
             .json(f"{root}/users.json").select("id", "name", F.col("profile.real_name").alias("real_name")))
    return messages, users


def newest_days_per_chat(days: DataFrame, n: int = fixed.CHAT_MAX_DAYS) -> DataFrame:
    return top_per_group(days, ["chat"], [F.desc("date")], n, "recency")


def chat_days_to_docs(messages: DataFrame, kind: str, n_days: int | None = None) -> DataFrame:
    """One document per chat and day with its authors and its lines in order of ``seq``, whatever that
    counts. All days unless ``n_days`` asks for the newest ones of each chat. A document's text is one
    row, so the lines of one day of one chat meet in one group and no more than these do."""
    rows = messages
    if n_days is not None:
        kept = newest_days_per_chat(messages.select("chat", "date").distinct(), n_days).drop("recency")
        rows = messages.join(kept, ["chat", "date"])
    said = F.concat("author", F.lit(": "), "message")
    lines = F.transform(F.sort_array(F.collect_list(F.struct("seq", said.alias("said")))), lambda s: s["said"])
    docs = rows.groupBy("chat", "date").agg(
        F.sort_array(F.collect_set("author")).alias("people"), F.count(F.lit(1)).alias("messages"),
        F.array_join(lines, "\n").alias("said"))
    day = F.col("date").cast("string")
    path = F.concat(F.lit(f"{kind}://"), "chat", F.lit("/"), day)
    return docs.select(
        natural_id("doc", path).alias("id"), path.alias("path"), F.concat("chat", F.lit(" · "), day).alias("title"),
        F.lit("chat").alias("doc_type"), "date",
        F.concat(F.lit("# "), "chat", F.lit(" — "), day, F.lit("\n\n"), "said").alias("body"), "people",
        F.array().cast("array<string>").alias("organizations"), F.lit(None).cast("string").alias("project"),
        F.array().cast("array<string>").alias("tags"),
        F.create_map(F.lit("source"), F.lit(kind), F.lit("chat"), F.col("chat"),
                     F.lit("messages"), F.col("messages").cast("string")).alias("metadata"),
        F.lit(None).cast("string").alias("area"))
