"""Table schemas, and views of general tables as experience logs and corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EXPERIENCE = "id long, ticks long, episode int, step int, obs array<float>, act int, reward float, next_obs array<float>, terminal boolean, tags array<string>"
ENVELOPE = "id long, ticks long, episode int, step int, reward float, terminal boolean, obs_kind byte, act_kind byte, obs binary, act binary, next_obs binary, tags array<string>"
INDEX = "id long, file_offset long, ticks long, reward float, flags short, file_id short, episode int"
VOCAB = "id int, token string"
MERGES = "rank int, lhs string, rhs string"
NGRAM = "n int, ctx string, tok string, cnt long"
SENSE = "lemma string, pos string, synset_id string, gloss string, examples array<string>"
EXAMPLE = "ex_id long, tokens array<string>, target_index int, lemma string, pos string, gold string"
TOKEN = "sent_id long, i int, token string, tag string"

#: 100 ns ticks from 0001-01-01 to 1970-01-01.
EPOCH_TICKS = 621355968000000000
KIND_VECTOR, KIND_TEXT = 1, 2


def ticks(ts, local: bool = False):
    """Timestamp column as 100 ns ticks since 0001-01-01; local: one without a zone, read as UTC whatever the session's zone."""
    at = F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone()) if local else ts
    return F.unix_micros(at) * 10 + F.lit(EPOCH_TICKS)


def experience(events: DataFrame) -> DataFrame:
    """An event table as an experience log: one episode a user, acts by event type in alphabetical order."""
    kinds = F.array(*map(F.lit, ["click", "error", "purchase", "signup", "view"]))
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(
        F.col("event_id").alias("id"),
        ticks(F.col("ts"), dict(events.dtypes)["ts"] == "timestamp_ntz").alias("ticks"),
        F.col("user_id").cast("int").alias("episode"),
        (F.row_number().over(order) - 1).cast("int").alias("step"),
        F.array(F.lit(1.0), F.col("value")).alias("obs"),
        (F.array_position(kinds, F.col("event_type")) - 1).cast("int").alias("act"),
        F.col("value").alias("reward"),
        F.lead(F.array(F.lit(1.0), F.col("value"))).over(order).alias("next_obs"),
        F.lead(F.lit(False), 1, True).over(order).alias("terminal"),
    )
