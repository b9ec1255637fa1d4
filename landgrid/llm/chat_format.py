"""Chat formatting into budgeted windows, in DataFrame operations only.

Prefix sums of turn tokens lay a conversation on a line that is cut into cells of
`stride` tokens. The turns that lie within a cell form a window; a turn that crosses
into the next cell forms one of its own. So each turn is owned by one window, windows
begin and end with turns, and hold at most `stride` own tokens unless a single turn is
longer. Before them a window repeats the system turn and the turns that begin within
the last `history` tokens; repeated turns carry no loss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import n_plain_words, read, shared_dir

START, END = "<|im_start|>", "<|im_end|>\n"
#: Control strings are a first character and one of these; an escaped one has backslashes between.
_REST = r"(\|im_start\|>|\|im_end\|>|s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\])"
#: Tokens that marking a turn costs.
TURN_TOKENS = 2
#: Turn numbers are summed in runs of so many before whole conversations are.
RUN = 256


def escape(text: Column) -> Column:
    """One more backslash inside each control string, escaped or not."""
    return F.regexp_replace(text, r"([<\[])(\\*)" + _REST, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    """One backslash less inside each escaped control string."""
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _REST, "$1$2$3")


def laid_out(conversations: DataFrame, stride: int) -> DataFrame:
    """Turns with `s` (tokens before), `tokens`, `nth`, `cell` and `cross`.

    Order within a conversation: turn (null first), role, text. Sums are taken within
    runs of turn numbers, then over one row per run, so that a conversation of any
    length is spread over tasks.
    """
    turns = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col("turn") / RUN), F.lit(-(2**62))).alias("run"),
    ).withColumn("tokens", n_plain_words(F.col("text")) + TURN_TOKENS)
    order = Window.partitionBy("conv_id", "run").orderBy(F.col("turn").asc_nulls_first(), "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    inner = turns.withColumns({"s": F.coalesce(F.sum("tokens").over(order), F.lit(0)), "nth": F.count(F.lit(1)).over(order)})
    runs = turns.groupBy("conv_id", "run").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        F.col("conv_id").alias("c"), F.col("run").alias("r"),
        F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"),
    )
    both = inner.join(runs.hint("merge"), inner["conv_id"].eqNullSafe(runs["c"]) & (inner["run"] == runs["r"]))
    s = F.col("s") + F.col("t0")
    return both.select(
        "conv_id", "turn", "role", "text", "tokens", s.alias("s"), (F.col("nth") + F.col("n0")).alias("nth"),
        F.floor(s / stride).alias("cell"), (s + F.col("tokens") > (F.floor(s / stride) + 1) * stride).alias("cross"),
    )


def format_windows(conversations: DataFrame, *, stride: int = 384, history: int = 96, target: str = "assistant") -> DataFrame:
    """One row per window: conv_id, cell, part, n_own, n_context, tokens, text, spans.

    text is the formatted window; spans are the half-open ranges of its code points
    that carry loss: the bodies of own turns whose role is `target`. The first
    n_context turns are repeated ones. `stride` + `history` + the system turn bound
    the tokens of a window; a single longer turn is kept whole in a window of its own.

    Null roles and texts count as empty, null conv_ids as one conversation; repeated
    rows are turns of their own; empty tables give no windows; other columns are not
    carried over.
    """
    if not 0 <= history < stride:
        raise ValueError("history must be shorter than the stride")
    turns = laid_out(conversations, stride)
    ahead = (F.col("tokens") <= history) & (F.col("s") + history >= (F.col("cell") + 1) * stride)
    cells = F.when(ahead, F.array(F.col("cell"), F.col("cell") + 1)).otherwise(F.array(F.col("cell")))
    block = F.concat(F.lit(START), F.url_encode("role"), F.lit("\n"), escape(F.col("text")), F.lit(END))
    body = F.length(F.url_encode("role")) + len(START) + 1
    shaped = turns.select(
        "conv_id", F.col("cell").alias("home"), F.explode(cells).alias("cell"),
        F.struct("s", "nth", "cross", "tokens", (F.col("role") == target).alias("wanted"), (F.col("nth") == 0).__and__(F.col("role") == "system").alias("system"), body.cast("int").alias("body"), block.alias("block")).alias("t"),
    )
    members = shaped.select("conv_id", "cell", F.struct(F.col("t.s"), F.col("t.nth"), (F.col("home") == F.col("cell")).alias("own"), F.col("t")).alias("m"))
    grouped = members.groupBy("conv_id", "cell").agg(F.array_sort(F.collect_list("m")).alias("all"))
    system = turns.where("nth = 0 and role = 'system'").select(
        F.col("conv_id").alias("c"), F.concat(F.lit(START), F.url_encode("role"), F.lit("\n"), escape(F.col("text")), F.lit(END)).alias("sys"), F.col("tokens").alias("sys_tokens"))
    grouped = grouped.join(system.hint("merge"), grouped["conv_id"].eqNullSafe(system["c"]), "left").drop("c")

    parts = grouped.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("part"))
    parts = parts.withColumn("mine", F.filter("all", lambda m: m["own"] & (m["t"]["cross"] == (F.col("part") == 1)))).where("size(mine) > 0")
    first = F.element_at("mine", 1)["s"]
    parts = parts.withColumn("past", F.filter("all", lambda m: (m["s"] < first) & (m["s"] >= first - history)))
    owns_system = F.exists("mine", lambda m: m["t"]["system"]) | F.exists("past", lambda m: m["t"]["system"])
    lead = F.when(F.col("sys").isNull() | owns_system, F.lit("")).otherwise(F.col("sys"))
    parts = parts.withColumn("lead", lead).withColumn("prefix", F.concat("lead", F.array_join(F.transform("past", lambda m: m["t"]["block"]), "")))
    begin = F.struct(F.length("prefix").alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans"))

    def step(acc: Column, m: Column) -> Column:
        whole = F.length(m["t"]["block"])
        span = F.struct((acc["at"] + m["t"]["body"]).alias("begin"), (acc["at"] + whole - len(END)).alias("end"))
        return F.struct((acc["at"] + whole).alias("at"), F.when(m["t"]["wanted"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    total = F.aggregate("mine", F.lit(0).cast("long"), lambda acc, m: acc + m["t"]["tokens"]) + F.aggregate("past", F.lit(0).cast("long"), lambda acc, m: acc + m["t"]["tokens"])
    return parts.select(
        "conv_id", "cell", "part", F.size("mine").alias("n_own"),
        (F.size("past") + F.when(F.col("lead") == "", 0).otherwise(1)).alias("n_context"),
        (total + F.when(F.col("lead") == "", 0).otherwise(F.col("sys_tokens"))).alias("tokens"),
        F.concat("prefix", F.array_join(F.transform("mine", lambda m: m["t"]["block"]), "")).alias("text"),
        F.aggregate("mine", begin, step)["spans"].alias("spans"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation what its windows say: own turns in order, text under loss, sizes.

    A digest needs its conversation's whole text in order, so the last grouping has
    one row per window, already cut down to own turns.
    """
    blocks = F.split("text", r"<\|im_end\|>\n")
    own = F.slice(blocks, F.col("n_context") + 1, F.col("n_own"))
    own_text = F.array_join(F.transform(own, lambda b: F.concat(
        F.url_decode(F.substring_index(F.substring(b, len(START) + 1, 2**31 - 1), "\n", 1)), F.lit("\n"),
        unescape(F.substr(b, F.locate("\n", b) + 1)), F.lit("\n"))), "")
    loss = F.array_join(F.transform("spans", lambda x: unescape(F.substr(F.col("text"), x["begin"] + 1, x["end"] - x["begin"]))), "")
    pieces = windows.select("conv_id", F.struct("cell", "part", "n_own", own_text.alias("own"), loss.alias("loss"), F.length("text").alias("chars")).alias("w"))
    whole = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("ws"), F.sum("w.n_own").alias("n_turns"), F.sum("w.chars").alias("formatted_chars"))
    loss_text = F.array_join("ws.loss", "")
    return whole.select(
        "conv_id", F.col("n_turns").cast("long"), F.sha2(F.array_join("ws.own", ""), 256).alias("turns_sha256"),
        F.length(loss_text).cast("long").alias("loss_chars"), F.sha2(loss_text, 256).alias("loss_sha256"), F.col("formatted_chars").cast("long"),
    )


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_dir(spark)
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(format_windows(rows))


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (
  SELECT *, len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')) + 2 AS tokens,
    24 + length(url_encode(role)) + length(regexp_replace(text, '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\])', '\1\\\2\3', 'g')) AS chars
  FROM c),
l AS (
  SELECT *, sum(tokens) OVER o - tokens AS s, row_number() OVER o - 1 AS nth
  FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)),
k AS (SELECT *, s // 384 AS cell, s + tokens > (s // 384 + 1) * 384 AS crosses FROM l),
w AS (SELECT conv_id, cell, crosses, min(s) AS f, min(nth) AS lowest, sum(chars) AS own FROM k GROUP BY ALL),
h AS (SELECT w.conv_id, w.cell, w.crosses, sum(k.chars) AS past, min(k.nth) AS lowest FROM w JOIN k ON w.conv_id = k.conv_id AND k.s < w.f AND k.s >= w.f - 96 GROUP BY ALL),
y AS (SELECT conv_id, chars AS sys FROM k WHERE nth = 0 AND role = 'system'),
f AS (
  SELECT w.conv_id, sum(own + coalesce(past, 0) + CASE WHEN w.lowest = 0 OR coalesce(h.lowest, 1) = 0 THEN 0 ELSE coalesce(sys, 0) END) AS formatted_chars
  FROM w LEFT JOIN h ON w.conv_id = h.conv_id AND w.cell = h.cell AND w.crosses = h.crosses LEFT JOIN y ON w.conv_id = y.conv_id GROUP BY w.conv_id),
d AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY nth), '') AS loss
  FROM l GROUP BY conv_id)
SELECT d.conv_id, n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM d JOIN f USING (conv_id)
"""
