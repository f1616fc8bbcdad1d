"""Preference pairs of conversations: one prompt, two completions, and which parts of them are trained on. DataFrame functions only.

The prompt is the longest common turn prefix of both conversations (equal role and text, turn by turn), rendered
once. What follows on either side is its completion. The mask of a completion lists the spans (code points from the completion's start, end
exclusive) of assistant content with its end marker: loss is taken there and nowhere else. A marker inside a text is broken by a space, so
no text can open or close a turn.

A pair is one row that holds its turns; conversations meet by pair id only. `next_best` builds pairs from plain conversations: the chosen
one ends with its last assistant turn, the rejected one ends with the last assistant turn of another
conversation (the one whose id differs in the last bit) in its place.

Edge cases: a null text is empty, a null role is "unknown". Turns stand by turn number, nulls first, then by role and text. Rows
without id belong to no conversation and are left out. Repeated rows are turns said twice. Equal conversations, and a lone answered one, which is its own partner, give a
pair with two empty completions. Conversations without assistant turn form no pair; every other one forms one. Empty tables give an
empty result. Columns other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from watchfold.llm.registry import query, table

OPEN, CLOSE, BREAK = "<|im_start|>", "<|im_end|>", "\n"
RANGES = 256


def turn_lists(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, turns): the turns of each conversation in order, with null role and text filled in."""
    said = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_list(said)).alias("turns"))


def _safe(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<|im_start|"), F.lit("<| im_start|")), F.lit("<|im_end|"), F.lit("<| im_end|"))


def _head(t: Column) -> Column:
    return F.concat(F.lit(OPEN), F.translate(_safe(t["role"]), "\n\r", "  "), F.lit(BREAK))


def _body(t: Column) -> Column:
    return F.concat(_safe(t["text"]), F.lit(CLOSE))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t), F.lit(BREAK))), "")


def trained_spans(turns: Column) -> Column:
    """(start, end) of what `rendered(turns)` says for the assistant."""
    def step(acc, t):
        start = acc["at"] + F.length(_head(t))
        end = start + F.length(_body(t))
        span = F.when(t["role"] == "assistant", F.array(F.struct(start.alias("start"), end.alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
        return F.struct((end + len(BREAK)).alias("at"), F.concat(acc["out"], span).alias("out"))
    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out")), step)["out"]


def common_turns(a: Column, b: Column) -> Column:
    """Number of leading turns with equal role and text."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    differs = F.array_position(same, F.lit(False))
    return F.when(differs > 0, differs - 1).otherwise(F.size(same)).cast("int")


def preferences(chosen: DataFrame, rejected: DataFrame, key: str = "pair_id") -> DataFrame:
    """(key, prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask) from two tables (key, turns)."""
    both = chosen.select(F.col(key), F.col("turns").alias("a")).join(rejected.select(F.col(key).alias("__key"), F.col("turns").alias("b")), F.col(key) == F.col("__key"))
    cut = both.withColumn("n", common_turns(F.col("a"), F.col("b")))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.size(c))
    return cut.select(key, F.col("n").alias("prompt_turns"), rendered(F.slice("a", F.lit(1), F.col("n"))).alias("prompt"),
                      rendered(rest("a")).alias("chosen"), trained_spans(rest("a")).alias("chosen_mask"),
                      rendered(rest("b")).alias("rejected"), trained_spans(rest("b")).alias("rejected_mask"))


def neighbours(ids: DataFrame, key: str) -> DataFrame:
    """(key, partner): the next smaller of distinct whole numbers, the greatest for the smallest."""
    steps = F.array(*[F.lit(k / RANGES) for k in range(1, RANGES)])
    cuts = ids.agg(F.percentile_approx(key, steps, F.lit(10_000)).alias("cuts"))
    ranged = ids.crossJoin(F.broadcast(cuts)).select(key, F.size(F.filter("cuts", lambda c: c < F.col(key))).alias("range"))
    ends = ranged.groupBy("range").agg(F.max(key).alias("end"))
    # one row for each range: at most RANGES rows
    before = ends.select(F.col("range").alias("__range"), F.coalesce(F.lag("end").over(W.orderBy("range")), F.max("end").over(W.partitionBy())).alias("before"))
    inside = ranged.withColumn("partner", F.lag(key).over(W.partitionBy("range").orderBy(key)))
    return inside.join(F.broadcast(before), F.col("range") == F.col("__range")).select(key, F.coalesce("partner", "before").alias("partner"))


def next_best(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected turn lists (pair_id, turns) from plain conversations."""
    lists = turn_lists(rows)
    spoken = F.filter(F.transform("turns", lambda t, i: F.struct(i.alias("at"), t["role"].alias("role"), t["text"].alias("text"))), lambda t: t["role"] == "assistant")
    ended = lists.withColumn("last", F.try_element_at(spoken, F.lit(-1))).where("last IS NOT NULL")
    answered = rows.where((F.col("role") == "assistant") & F.col("conv_id").isNotNull()).select("conv_id").distinct()
    mine = ended.select(F.col("conv_id").alias("pair_id"), "turns", "last")
    answers = ended.select(F.col("conv_id").alias("partner"), F.col("last.text").alias("other"))
    theirs = neighbours(answered, "conv_id").join(answers, "partner").select(F.col("conv_id").alias("pair_id"), "other")
    met = mine.join(theirs, "pair_id")
    chosen = met.select("pair_id", F.slice("turns", F.lit(1), F.col("last.at") + 1).alias("turns"))
    swapped = F.concat(F.slice("turns", F.lit(1), F.col("last.at")), F.array(F.struct(F.get("turns", F.col("last.at"))["turn"].alias("turn"), F.lit("assistant").alias("role"), F.col("other").alias("text"))))
    return chosen, met.select("pair_id", swapped.alias("turns"))


_BROKEN = "replace(replace({}, '<|im_start|', '<| im_start|'), '<|im_end|', '<| im_end|')"
_SAFE = f"{_BROKEN.format('t.text')} || '{CLOSE}'"
_LINE = f"'{OPEN}' || translate({_BROKEN.format('t.role')}, chr(10) || chr(13), '  ') || chr(10) || {_SAFE} || chr(10)"


def _mask_sql(turns: str) -> str:
    ends = f"list_transform(range(1, len({turns}) + 1), lambda i: coalesce(list_sum(list_transform({turns}[1:i], lambda t: length({_LINE}))), 0)::bigint)"
    return (f"list_aggregate(list_filter(list_transform(range(1, len({turns}) + 1), lambda i: CASE WHEN {turns}[i].role = 'assistant' THEN "
            f"({ends}[i] - length(list_transform([{turns}[i]], lambda t: {_SAFE})[1]) - 1)::varchar || ':' || ({ends}[i] - 1)::varchar END), lambda x: x IS NOT NULL), 'string_agg', ',')")


CHAT_SQL = f"""
WITH c AS (SELECT conv_id, list({{'turn': turn, 'role': coalesce(role, 'unknown'), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS turns
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
e AS (SELECT *, len(turns) + 1 - list_position(list_reverse(list_transform(turns, lambda t: t.role)), 'assistant') AS last FROM c
    WHERE list_contains(list_transform(turns, lambda t: t.role), 'assistant')),
q AS (SELECT conv_id, coalesce(lag(conv_id) OVER (ORDER BY conv_id), max(conv_id) OVER ()) AS partner FROM e),
p AS (SELECT m.conv_id AS pair_id, m.turns[1:m.last] AS a, m.turns[1:m.last - 1] || [{{'turn': m.turns[m.last].turn, 'role': 'assistant', 'text': o.turns[o.last].text}}] AS b
    FROM e m JOIN q ON q.conv_id = m.conv_id JOIN e o ON o.conv_id = q.partner),
n AS (SELECT *, coalesce(list_position(list_transform(range(1, len(a) + 1), lambda i: a[i].role = b[i].role AND a[i].text = b[i].text), false) - 1, len(a)) AS n FROM p),
r AS (SELECT pair_id, n, a[1:n] AS p, a[n + 1:] AS x, b[n + 1:] AS y FROM n)
SELECT pair_id, n::int AS prompt_turns, array_to_string(list_transform(p, lambda t: {_LINE}), '') AS prompt,
    array_to_string(list_transform(x, lambda t: {_LINE}), '') AS chosen, coalesce({_mask_sql('x')}, '') AS chosen_mask,
    array_to_string(list_transform(y, lambda t: {_LINE}), '') AS rejected, coalesce({_mask_sql('y')}, '') AS rejected_mask FROM r"""


@query("op8_chat", CHAT_SQL)
def op8_chat(spark, sf_dir):
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    found = preferences(*next_best(table(spark, sf_dir, "conversations")))
    return found.withColumns({c: listed(c) for c in ("chosen_mask", "rejected_mask")})
