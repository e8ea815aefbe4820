"""UI-event log lines ``LEVEL [asctime] body`` with a flat JSON body of one of
three kinds (click, mouse_move, css_load).  Parsing is built-in
``regexp_extract`` + ``from_json``; lines that do not parse go to a side table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .tables import epoch_millis

# Line layout and body fields of the event logger; browsers send
# positions, sizes and times with fractions.
LINE = r"^([A-Z]+) \[([^\]]+)\] (.*)$"
TEXT_FIELDS = ["stat_type", "element_id", "element_class_name", "element_tag_name", "element_oktarget"]
NUMBER_FIELDS = ["element_position_top_left_x", "element_position_top_left_y", "element_position_bottom_right_x",
                 "element_position_bottom_right_y", "mouse_position_x", "mouse_position_y", "window_width", "window_height",
                 "client_timestamp", "max_css_load_duration", "min_css_load_duration"]
BODY_SCHEMA = StructType([StructField(c, StringType()) for c in TEXT_FIELDS] + [StructField(c, DoubleType()) for c in NUMBER_FIELDS])


def split_line(df: DataFrame, col: str = "value") -> DataFrame:
    """line, level, asctime and the parsed body: one match of the layout a line."""
    found = df.select(F.col(col).alias("line"), F.regexp_extract_all(F.col(col), F.lit(LINE), F.lit(0)).alias("hit"))
    hit = F.size("hit") > 0
    # With the layout known to fit, its parts are cut at the first '[', ']' and the blank after it.
    start, end = F.locate(" [", F.col("line")), F.locate("] ", F.col("line"))
    part = lambda a, n: F.when(hit, F.col("line").substr(a, n))
    return found.select("line", part(F.lit(1), start - 1).alias("level"), part(start + 2, end - start - 2).alias("asctime"),
                        F.from_json(part(end + 2, F.length("line")), BODY_SCHEMA, {"mode": "PERMISSIVE"}).alias("j"))


def parse_lines(df: DataFrame, col: str = "value") -> DataFrame:
    """Good events, one row each, with every field of every kind (those of other kinds are null)."""
    ok = split_line(df, col).where(F.col("j.stat_type").isNotNull())
    return ok.select("level", "asctime", "j.*")


def corrupt_lines(df: DataFrame, col: str = "value") -> DataFrame:
    """Side table: lines without the layout or without a parsable body."""
    return split_line(df, col).where(F.col("j.stat_type").isNull()).select("line")


def render_from_events(ev: DataFrame) -> DataFrame:
    """Stand-in log lines built by Spark from the events table (one per event).

    click / signup -> click body, view -> mouse_move, purchase -> css_load,
    error -> a line whose body is not JSON (goes to the side table).
    """
    # k and the epoch milliseconds are computed once per row, then referenced.
    ev = ev.select("ts", "user_id", "event_type", F.regexp_extract(F.col("props"), r'"k":\s*(\d+)', 1).alias("_k"),
                   epoch_millis(ev, "ts").alias("_ms"))
    k, ms = F.col("_k"), F.col("_ms")
    uid = F.col("user_id").cast("string")
    click = F.concat(F.lit('{"stat_type": "click", "element_id": "el'), k, F.lit('", "element_class_name": "c'), k,
                     F.lit(' btn", "element_tag_name": "BUTTON", "element_oktarget": "t'), uid,
                     F.lit('", "element_position_top_left_x": '), k, F.lit('.25, "element_position_top_left_y": '), uid,
                     F.lit(', "element_position_bottom_right_x": '), k, F.lit('.75, "element_position_bottom_right_y": '), uid,
                     F.lit('.5, "mouse_position_x": '), k, F.lit('.5, "mouse_position_y": '), uid,
                     F.lit(', "window_width": 1280, "window_height": 720, "client_timestamp": '), ms.cast("string"),
                     F.lit(".5}"))
    move = F.concat(F.lit('{"stat_type": "mouse_move", "window_width": 1920, "window_height": 1080, "mouse_position_x": '),
                    uid, F.lit(', "mouse_position_y": '), k, F.lit('.5, "client_timestamp": '), ms.cast("string"), F.lit("}"))
    css = F.concat(F.lit('{"stat_type": "css_load", "max_css_load_duration": '), k,
                   F.lit(', "min_css_load_duration": '), uid, F.lit("}"))
    body = (F.when(F.col("event_type").isin("click", "signup"), click).when(F.col("event_type") == "view", move)
            .when(F.col("event_type") == "purchase", css).otherwise(F.concat(F.lit("not json "), k)))
    level = F.when(F.col("event_type") == "purchase", "WARNING").otherwise("INFO")
    asct = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(","),
                    F.lpad((ms % 1000).cast("string"), 3, "0"))
    return ev.select(F.concat(level, F.lit(" ["), asct, F.lit("] "), body).alias("value"))
