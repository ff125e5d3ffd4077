"""Token sequences of sessions and their surprisal under a bigram model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..options import DEFAULTS, Options
from .sessions import session_events
from .skew import weighted_join

PAD, UNKNOWN = 0, 1
# Destination ports counted as rare.
RARE_PORTS = (4444, 8081, 1337, 9001)
SESSION = ["session_id", "user_name", "ip", "session_start"]


def event_token() -> Column:
    """source:event_type, with a few command families and rare ports named apart."""
    cmd = F.when(F.col("source") == "process", F.col("command"))
    return (
        F.when(cmd.contains("curl ") | cmd.contains("wget "), "process:download")
        .when(cmd.contains("useradd") | cmd.contains("chpasswd"), "process:account_create")
        .when(cmd.contains("ssh "), "process:ssh")
        .when(
            (F.col("source") == "network") & F.col("dst_port").isin(*RARE_PORTS),
            "network:rare_port",
        )
        .otherwise(F.concat_ws(":", "source", "event_type"))
    )


def token_vocab(events: DataFrame, opts: Options = DEFAULTS) -> DataFrame:
    """token, n, token_id; ids from 2 by falling count. Every event is in some session, so
    the counts need no sessions. One row per kind of event is ranked."""
    counted = (
        events.groupBy(event_token().alias("token"))
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= opts.token_min_count)
    )
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "token"))
    return counted.withColumn("token_id", (rank + 1).cast("int"))


def session_tail(
    events: DataFrame,
    vocab: DataFrame,
    opts: Options = DEFAULTS,
    slots: DataFrame | None = None,
) -> DataFrame:
    """The last max_sequence_len tokens of each session, one row each, newest first by rn.

    The rank limit applies before the shuffle on the session: a session holding a third of
    all events sends at most max_sequence_len rows per task."""
    tagged = session_events(
        events.select("event_id", "ts", "source", "event_type", "user_name", "ip", "dst_port",
                      "command"),
        opts,
        slots,
    )
    newest = Window.partitionBy(*SESSION).orderBy(F.desc("ts"), F.desc("event_id"))
    tail = (
        tagged.select(*SESSION, "ts", "event_id", event_token().alias("token"))
        .withColumn("rn", F.row_number().over(newest))
        .filter(F.col("rn") <= opts.max_sequence_len)
    )
    # A handful of tokens holds most rows.
    known = vocab.select("token", "token_id", F.col("n").alias("n_token"))
    joined = weighted_join(tail, known, ["token"], "n_token", ["event_id"], "left")
    return joined.withColumn(
        "token_id", F.coalesce("token_id", F.lit(UNKNOWN))
    )


def token_sequences(events: DataFrame, vocab: DataFrame, opts: Options = DEFAULTS) -> DataFrame:
    """Token ids per session in time order (at most max_sequence_len) and their number."""
    tail = session_tail(events, vocab, opts)
    return (
        tail.groupBy(*SESSION)
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("rn")).alias("o"), "token_id"))).alias("t"))
        .select(*SESSION, F.col("t.token_id").alias("token_ids"), F.size("t").alias("length"))
    )


def session_transitions(tail: DataFrame) -> DataFrame:
    """Token pairs per session with their number; the first token follows PAD."""
    in_order = Window.partitionBy(*SESSION).orderBy(F.desc("rn"))
    return (
        tail.withColumn("prev_id", F.lag("token_id", 1, PAD).over(in_order))
        .groupBy(*SESSION, "prev_id", "token_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def fit_transitions(pairs: DataFrame) -> DataFrame:
    """prev_id, token_id, n_pair: at most (vocabulary + 2) squared rows."""
    return pairs.groupBy("prev_id", "token_id").agg(F.sum("n").alias("n_pair"))


def surprisal(pairs: DataFrame, transitions: DataFrame, vocab: DataFrame) -> DataFrame:
    """Mean -log p(token | previous token) per session with add-one smoothing."""
    known = transitions.withColumn("n_rows", F.col("n_pair"))
    size = vocab.agg((F.count(F.lit(1)) + 1).cast("double").alias("vocab_size"))
    contexts = transitions.groupBy("prev_id").agg(
        F.sum("n_pair").alias("n_context"), F.sum("n_pair").alias("n_rows")
    )
    p = (F.coalesce("n_pair", F.lit(0)) + F.lit(1.0)) / (
        F.coalesce("n_context", F.lit(0)) + F.col("vocab_size")
    )
    seen = weighted_join(pairs, known, ["prev_id", "token_id"], "n_rows", SESSION, "left")
    return (
        weighted_join(seen, contexts, ["prev_id"], "n_rows", SESSION, "left")
        .crossJoin(F.broadcast(size))  # one row
        .groupBy(*SESSION)
        .agg(
            (F.sum(-F.log(p) * F.col("n")) / F.sum("n")).alias("raw_score"),
            F.sum("n").alias("length"),
        )
    )
