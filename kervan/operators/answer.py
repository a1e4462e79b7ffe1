"""Batch answer assembly: context, guard, chat through a plug-in, checks, sources and disclaimer.

Every column is keyed by query_id, so one plan serves one question or a million. Hits per query are at most k.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kervan.functions import guard
from kervan.functions.guard import GuardPolicy
from kervan.functions.text import chunk_body, quantities, strip, unsupported
from kervan.functions.udfs import casefold_all_udf, casefold_udf
from kervan.operators.models import loaded, model_key

ChatFunction = Callable[[Sequence[dict]], str]
ROLES = ("system", "user", "assistant")


def collect_hits(hits: DataFrame) -> DataFrame:
    """(query_id, hits): each query's hits in rank order (k of them at most)."""
    fields = ["rank", "medicine_name", "chunk_type", "chunk_text", "source_name"]
    return hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("hits"))


def render_context(hits: Column) -> Column:
    """Numbered source blocks in rank order, blanks shown as unstated."""

    def shown(c: Column) -> Column:
        return F.coalesce(F.nullif(c, F.lit("")), F.lit(guard.UNSTATED))

    def block(h: Column, i: Column) -> Column:
        return F.concat(
            F.lit(guard.BLOCK_HEAD), (i + 1).cast("string"), F.lit("]\n" + guard.BLOCK_NAME), shown(h["medicine_name"]), F.lit("\n" + guard.BLOCK_KIND), shown(h["chunk_type"]),
            F.lit("\n" + guard.BLOCK_TEXT), F.coalesce(h["chunk_text"], F.lit("")), F.lit("\n" + guard.BLOCK_SOURCE), shown(h["source_name"]),
        )

    return F.array_join(F.transform(hits, block), "\n\n")


def source_line(hits: Column) -> Column:
    names = F.array_distinct(F.transform(hits, lambda h: F.coalesce(F.nullif(h["source_name"], F.lit("")), F.lit(guard.UNSTATED))))
    return F.when(F.size(names) > 0, F.array_join(names, ", ")).otherwise(F.lit(guard.NO_SOURCES))


def finalise(answer: Column, hits: Column) -> Column:
    return F.concat(strip(answer), F.lit(guard.MARKER), source_line(hits), F.lit("\n\n" + guard.DISCLAIMER))


def has_critical(hits: Column, policy: GuardPolicy = GuardPolicy()) -> Column:
    return F.exists(hits, lambda h: guard.is_critical_source(h["chunk_type"], h["chunk_text"], policy))


def has_overlap(hits: Column) -> Column:
    """Whether two hits share medicine and category, in any case of letters."""
    keys = casefold_all_udf(F.transform(hits, lambda h: F.concat_ws("\x1f", F.coalesce(h["medicine_name"], F.lit("")), F.coalesce(h["chunk_type"], F.lit("")))))
    return F.size(keys) > F.size(F.array_distinct(keys))


def safety_notes(hits: Column, policy: GuardPolicy = GuardPolicy()) -> Column:
    def yes(c: Column) -> Column:
        return F.when(c, F.lit(guard.YES)).otherwise(F.lit(guard.NO))

    return F.concat(
        F.lit(guard.NOTE_CRITICAL), yes(has_critical(hits, policy)), F.lit(".\n" + guard.NOTE_OVERLAP), yes(has_overlap(hits)), F.lit(". " + guard.NOTE_CONFLICT),
    )


def general_texts(hits: Column, n: int = 2, policy: GuardPolicy = GuardPolicy()) -> Column:
    """Texts of the first n hits of a general category, in rank order."""
    return F.transform(F.slice(F.filter(hits, lambda h: h["chunk_type"].isin(*policy.general_types)), 1, n), lambda h: F.coalesce(h["chunk_text"], F.lit("")))


def personal_answer(hits: Column, policy: GuardPolicy = GuardPolicy()) -> Column:
    texts = general_texts(hits, 2, policy)
    tail = F.when(F.size(texts) > 0, F.concat(F.lit(guard.GENERAL_INTRO + "\n"), F.array_join(texts, "\n\n"))).otherwise(F.lit(guard.NOT_FOUND))
    prefix = F.when(has_critical(hits, policy), F.lit(guard.WARNING_PREFIX + "\n\n")).otherwise(F.lit(""))
    return F.concat(prefix, F.lit(guard.REFUSAL + "\n\n"), tail)


def valid_messages(messages: Column) -> Column:
    """At least one message, each with a known role and content that isn't blank."""
    good = F.forall(messages, lambda m: F.coalesce(m["role"].isin(*ROLES) & (strip(m["content"]) != ""), F.lit(False)))
    return F.coalesce((F.size(messages) > 0) & good, F.lit(False))


def check_messages(messages: Sequence[dict]) -> list[dict]:
    """The messages with their contents stripped; an unknown role, blank content or an empty list raises."""
    if not messages:
        raise ValueError("messages are needed")
    for i, m in enumerate(messages):
        if m.get("role") not in ROLES:
            raise ValueError(f"message {i} has an unknown role")
        if not isinstance(m.get("content"), str) or not m["content"].strip():
            raise ValueError(f"message {i} is blank")
    return [{"role": m["role"], "content": m["content"].strip()} for m in messages]


def echo_chat(messages: Sequence[dict]) -> str:
    """Stand-in model: repeats the first source text of the prompt."""
    prompt, (head, tail) = messages[-1]["content"], ("\n" + guard.BLOCK_TEXT, "\n" + guard.BLOCK_SOURCE)
    return prompt.split(head, 1)[1].split(tail, 1)[0] if head in prompt else ""


def run_chat(df: DataFrame, load: Callable[[], ChatFunction], system: str, name: str = "chat") -> DataFrame:
    """df (query_id, prompt) with the model's `reply`; called once per row with checked messages, the model loaded once per worker."""
    key = model_key(name, load)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            given = [check_messages([{"role": "system", "content": system}, {"role": "user", "content": p}]) for p in f["prompt"]]
            replies = [loaded(key, load)(m) for m in given]
            yield pd.DataFrame({"query_id": f["query_id"], "reply": replies})

    return df.select("query_id", "prompt").mapInPandas(batches, "query_id long, reply string")


def answer(questions: DataFrame, hits: DataFrame, chat: ChatFunction = echo_chat, system: str = guard.SYSTEM_PROMPT, policy: GuardPolicy = GuardPolicy(), *, header_is_evidence: bool = False, load: Callable[[], ChatFunction] | None = None, name: str = "chat", trace: bool = False) -> DataFrame:
    """(query_id, response, outcome) for every question with a query_text that isn't blank.

    chat is the model itself; `load` makes it on the worker instead, once under `name`. trace adds model_called,
    question, retrieved_context and prompt (null where the model wasn't asked).

    Without hits the answer is "not found", even for a personal request; a personal request with hits gets the
    refusal; neither reaches the model. A reply that is blank, or states a quantity the sources don't, becomes
    "not found". The warning prefix comes last, where a source is critical and the answer holds no urgency word.
    Evidence is the chunk body; header_is_evidence lets the two header lines count too. Ties in rank can't occur.
    """
    q = questions.select("query_id", strip(F.col("query_text")).alias("question")).filter(F.col("question") != "")
    q = q.join(collect_hits(hits), "query_id", "left").withColumn("hits", F.coalesce("hits", F.array().cast("array<struct<rank:int,medicine_name:string,chunk_type:string,chunk_text:string,source_name:string>>")))
    q = q.withColumn("personal", guard.is_personal(casefold_udf("question"), policy) & (F.size("hits") > 0))
    ask = q.filter((F.size("hits") > 0) & ~F.col("personal")).withColumn(
        "prompt", F.concat(F.lit("Retrieved context:\n"), render_context(F.col("hits")), F.lit("\n\n"), safety_notes(F.col("hits"), policy), F.lit("\n\nSoru: "), F.col("question"))
    )
    replies = run_chat(ask, load or (lambda: chat), system, name)
    text = F.transform("hits", lambda h: F.coalesce(h["chunk_text"], F.lit("")) if header_is_evidence else chunk_body(F.coalesce(h["chunk_text"], F.lit(""))))
    r = q.join(replies, "query_id", "left").withColumn("reply", F.coalesce(strip(F.col("reply")), F.lit("")))
    r = r.withColumns({"_said": casefold_udf("reply"), "_known": casefold_udf(F.array_join(text, "\n"))})
    rejected = unsupported(quantities(F.col("_said"), policy.units, dict(policy.aliases)), quantities(F.col("_known"), policy.units, dict(policy.aliases)))
    outcome = (
        F.when(F.size("hits") == 0, F.lit("no_hits")).when(F.col("personal"), F.lit("refused"))
        .when(F.col("reply") == "", F.lit("no_reply")).when(rejected, F.lit("rejected")).otherwise(F.lit("answered"))
    )
    r = r.withColumn("outcome", outcome)
    base = F.when(F.col("outcome") == "refused", personal_answer(F.col("hits"), policy)).when(F.col("outcome") == "answered", F.col("reply")).otherwise(F.lit(guard.NOT_FOUND))
    r = r.withColumn("_base", base)
    warn = F.col("outcome").isin("answered", "rejected", "no_reply") & has_critical(F.col("hits"), policy) & ~guard.is_urgent(F.col("_base"), policy)
    final = F.when(warn, F.concat(F.lit(guard.WARNING_PREFIX + "\n\n"), F.col("_base"))).otherwise(F.col("_base"))
    out = r.withColumn("response", finalise(final, F.col("hits")))
    if not trace:
        return out.select("query_id", "response", "outcome")
    called = F.col("outcome").isin("answered", "rejected", "no_reply").alias("model_called")
    return out.join(ask.select("query_id", "prompt"), "query_id", "left").select("query_id", "response", "outcome", called, "question", render_context(F.col("hits")).alias("retrieved_context"), "prompt")
