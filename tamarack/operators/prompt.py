"""From hits to a prompt; summarising long questions; answers."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUESTION, SNIPPETS = "<<BUG_TEXT>>", "<<SNIPPETS>>"


def checked_question(text: str) -> str:
    if not text.strip():
        raise ValueError("the question is empty")
    return text.strip()


def context(hits: DataFrame) -> DataFrame:
    """query_id, context: the hits' numbered snippets in order of rank."""
    one = F.concat(F.format_string("[Snippet %d from %s chunk %s]\n", "rank", F.coalesce("source", F.lit("<unknown>")), F.coalesce(F.col("chunk_index").cast("string"), F.lit("?"))), F.col("document"))
    # At most k snippets a query: the array is bounded.
    parts = F.sort_array(F.collect_list(F.struct("rank", one.alias("s"))))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda p: p["s"]), "\n\n").alias("context"))


def _fill(template: Column, token: str, value: Column, heading: str) -> Column:
    return F.when(F.contains(template, F.lit(token)), F.replace(template, F.lit(token), value)).otherwise(F.concat(template, F.lit(f"\n\n{heading}:\n"), value))


def chat_prompt(template: Column, question: Column, snippets: Column) -> Column:
    """The question first, then the snippets: a question that holds the snippets' token is filled as well."""
    return _fill(_fill(template, QUESTION, question, "Bug description"), SNIPPETS, snippets, "Relevant snippets")


def summary_prompt(template: Column, text: Column) -> Column:
    return _fill(template, QUESTION, text, "Bug text")


def shortened(questions: DataFrame, summarise, max_chars: int = 4000) -> DataFrame:
    """questions (query_id, text) with texts of over max_chars replaced by summarise(DataFrame) -> DataFrame.

    Long questions are split off, so a summariser in Python sees no others.
    """
    long_ = F.length("text") > max_chars
    return questions.where(~long_).unionByName(summarise(questions.where(long_)).select(*questions.columns))


class Answerer(Protocol):
    def answer(self, prompts: DataFrame) -> DataFrame:
        """prompts (query_id, prompt, ...) with a column ``answer``."""


class ExtractiveAnswerer:
    """Offline: the first sentence of each snippet that shares a token with the question."""

    def answer(self, prompts: DataFrame) -> DataFrame:
        from ..functions.metrics import tokens

        sentences = F.filter(F.split("context", r"(?<=[.!?])\s+"), lambda s: F.arrays_overlap(tokens(s), tokens(F.col("question"))))
        return prompts.withColumn("answer", F.array_join(F.slice(sentences, 1, 3), " "))


def token_stream(messages: DataFrame, cancelled: DataFrame | None = None) -> DataFrame:
    """stream_id, answer, tokens, finished: chat messages (stream_id, seq, content, done) joined up to the first that is done.

    cancelled (stream_id, last_seq): streams that were stopped; later messages don't count.
    finished tells whether a stream came to its end.
    """
    if cancelled is not None:
        messages = messages.join(cancelled, "stream_id", "left").where(F.col("last_seq").isNull() | (F.col("seq") <= F.col("last_seq"))).drop("last_seq")
    before = W.partitionBy("stream_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    open_ = messages.withColumn("over", F.coalesce(F.max(F.col("done").cast("int")).over(before), F.lit(0))).where("over = 0")
    parts = F.sort_array(F.collect_list(F.struct("seq", F.coalesce("content", F.lit("")).alias("c"))))
    return open_.groupBy("stream_id").agg(F.array_join(F.transform(parts, lambda p: p["c"]), "").alias("answer"), F.count("*").alias("tokens"), F.coalesce(F.bool_or("done"), F.lit(False)).alias("finished"))


def emit(parts, on_token=None, is_cancelled=None) -> tuple[str, bool]:
    """(answer, finished) of a service's messages ({"message": {"content"}, "done"}), one by one.

    on_token is called with each piece of text as it comes; is_cancelled is asked before
    each message, and stops the stream.
    """
    out = []
    for part in parts:
        if is_cancelled is not None and is_cancelled():
            return "".join(out), False
        text = (part.get("message") or {}).get("content") or ""
        if text:
            out.append(text)
            if on_token is not None:
                on_token(text)
        if part.get("done"):
            return "".join(out), True
    return "".join(out), False
