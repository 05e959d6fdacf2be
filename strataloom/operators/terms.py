"""Terms: enrichment by a language model, the term knowledge base, term chunks, concerns."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..session import ship


class LanguageModel(Protocol):
    def complete(self, prompt: str, max_tokens: int = 512, temperature: float = 0.0) -> str: ...


class Echo:
    """A deterministic stand-in for a language model: the prompt's last line, shortened."""

    def complete(self, prompt: str, max_tokens: int = 512, temperature: float = 0.0) -> str:
        return prompt.strip().splitlines()[-1][: 4 * max_tokens].strip()


KB_SCHEMA = "raw_name string, expanded_name string, definition string, noun_tokens array<string>, functionalities array<struct<file_path:string,symbol_name:string,qualified_name:string,summary:string>>"


def symbol_terms(symbols: DataFrame, most: int = 5) -> DataFrame:
    """symbols with token and place: the first distinct words of name, then parent, stop words left out."""
    names = F.array_compact(F.array("name", "parent_name"))
    return symbols.select("*", F.posexplode(F.slice(text.noun_tokens(names, True), 1, most)).alias("place", "token"))


def enrich(tokens: DataFrame, model: LanguageModel, context_chars: int = 800) -> DataFrame:
    """token, expanded_name, definition. Distinct (token, context) pairs are asked once, so the distinct is the cache; a failure leaves its row out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for token, context in zip(pdf.token, pdf.context):
                try:
                    name = model.complete(f"Expand the identifier word in its code.\n{context or ''}\n{token}", 16) or token.replace("_", " ")
                    about = model.complete(f"Define the term in one sentence.\n{context or ''}\n{name}", 40) or f"Code concept related to {name}"
                except Exception:  # noqa: BLE001 - a model's failure skips the term
                    continue
                out.append((token, context, name, about))
            yield pd.DataFrame(out, columns=["token", "context", "expanded_name", "definition"])

    ship(tokens.sparkSession)
    wanted = tokens.select("token", F.substring(F.coalesce("context", F.lit("")), 1, context_chars).alias("context")).distinct()
    return wanted.mapInPandas(run, "token string, context string, expanded_name string, definition string")


def enrich_symbols(symbols: DataFrame, model: LanguageModel, most: int = 5) -> DataFrame:
    """(symbol_id, terms) of symbols with id, name, parent_name and source."""
    asked = symbol_terms(symbols, most).withColumn("context", F.substring(F.coalesce("source", F.lit("")), 1, 800))
    done = asked.join(enrich(asked, model), ["token", "context"])
    return done.groupBy(F.col("id").alias("symbol_id")).agg(F.array_sort(F.collect_list(F.struct("place", "token", "expanded_name", "definition"))).alias("terms"))


def term_chunks(pairs: DataFrame, model: LanguageModel, source_chars: int = 1000, most_tokens: int = 80) -> DataFrame:
    """pairs (symbol_name, expanded_name, definition, source, ...) with a summary of the term's role; unrelated and empty answers are dropped."""
    ship(pairs.sparkSession)
    schema = ", ".join(f"`{n}` {t}" for n, t in pairs.dtypes) + ", summary string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            answers = []
            for r in pdf.itertuples():
                try:
                    answers.append(model.complete(f"Say what the term does in the symbol, or NOT_RELATED.\n{r.definition}\n{(r.source or '')[:source_chars]}\n{r.symbol_name}: {r.expanded_name}", most_tokens))
                except Exception:  # noqa: BLE001
                    answers.append("")
            pdf = pdf.assign(summary=answers)
            yield pdf[(pdf.summary.str.strip() != "") & ~pdf.summary.str.contains("NOT_RELATED")]

    return pairs.mapInPandas(run, schema)


def knowledge_base(usages: DataFrame) -> DataFrame:
    """One entry for each expanded name whatever its case: the first term by seq, and all functionalities in order.

    usages has seq, raw_name, expanded_name, definition, noun_tokens and functionality (a struct).
    """
    tokens = F.when(F.size("noun_tokens") > 0, F.col("noun_tokens")).otherwise(text.split_identifier("expanded_name"))
    rows = usages.withColumn("noun_tokens", tokens)
    return (
        rows.groupBy(F.lower("expanded_name").alias("key"))
        .agg(F.min_by(F.struct("raw_name", "expanded_name", "definition", "noun_tokens"), "seq").alias("t"), F.array_sort(F.collect_list(F.struct("seq", "functionality"))).alias("f"))
        .select("key", "t.*", F.transform("f", lambda x: x["functionality"]).alias("functionalities"))
    )


def search_terms(kb: DataFrame, keywords: list[str]) -> DataFrame:
    """kb with overlap, the keywords among a term's words and its name; terms without any are left out."""
    wanted = F.array_distinct(F.array(*[F.lit(k.lower()) for k in keywords])) if keywords else F.array().cast("array<string>")
    own = F.array_union("noun_tokens", F.array(F.lower("expanded_name")))
    return kb.withColumn("overlap", F.size(F.array_intersect(wanted, own))).filter("overlap > 0").orderBy(F.desc("overlap"), F.lower("expanded_name"))


def search_terms_for(kb: DataFrame, query: str) -> DataFrame:
    words = [w for w in re.split(r"[^a-z0-9]+", query.lower()) if len(w) >= 2 and w not in text.STOP_WORDS]
    return search_terms(kb, words)


def get_term(kb: DataFrame, name: str) -> DataFrame:
    return kb.filter(F.lower("expanded_name") == name.lower())


def save_terms(kb: DataFrame, path: str) -> None:
    kb.write.mode("overwrite").json(path)


def load_terms(spark: SparkSession, path: str) -> DataFrame:
    """Saved terms; entries that share a name are merged in the order they are read."""
    rows = spark.read.schema(KB_SCHEMA).json(path).withColumn("seq", F.monotonically_increasing_id())
    one = rows.select("seq", "raw_name", "expanded_name", "definition", "noun_tokens", F.explode_outer("functionalities").alias("functionality"))
    merged = knowledge_base(one.withColumn("noun_tokens", F.coalesce("noun_tokens", F.array().cast("array<string>"))))
    return merged.withColumn("functionalities", F.array_compact("functionalities"))


def parse_answer(answer: str):
    """The JSON of an answer, with or without a code fence; None if there is none."""
    try:
        return json.loads(re.sub(r"\s*```$", "", re.sub(r"^```[a-zA-Z]*\s*", "", answer.strip())))
    except ValueError:
        return None


def build_concerns(chunks: DataFrame, groups: list[dict], most: int = 5) -> DataFrame:
    """(concern, name, description, chunk_places, symbols): places outside the list, or no numbers, are ignored; symbols keep their first place. chunks has place and qualified_name."""
    spark = chunks.sparkSession
    rows = []
    for c, g in enumerate(groups[:most]):
        for at, i in enumerate(g.get("indices", [])):
            if isinstance(i, int) and not isinstance(i, bool) or (isinstance(i, str) and i.isdigit()):
                rows.append((c, str(g.get("name", "")), str(g.get("description", "")), at, int(i)))
    named = spark.createDataFrame(rows, "concern int, name string, description string, at int, place int").join(chunks, "place")
    first = named.groupBy("concern", "qualified_name").agg(F.min("at").alias("first")).groupBy("concern").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "qualified_name"))), lambda x: x["qualified_name"]).alias("symbols"))
    whole = named.groupBy("concern", "name", "description").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "place"))), lambda x: x["place"]).alias("chunk_places"))
    return whole.join(first, "concern")


def rank_concerns(concerns: DataFrame, order: list) -> DataFrame:
    """concerns with rank: as ordered, each once, then what is not mentioned in its own order."""
    spots: dict[int, int] = {}
    for i in order:
        if isinstance(i, int) and i not in spots:
            spots[i] = len(spots)
    place = F.create_map(*[F.lit(x) for kv in spots.items() for x in kv]) if spots else F.lit(None).cast("map<int,int>")
    return concerns.withColumn("rank", F.row_number().over(Window.orderBy(F.coalesce(place[F.col("concern")], F.lit(1 << 30)), "concern")))


def cluster_concerns(chunks: DataFrame, query: str, model: LanguageModel, most: int = 5, most_chunks: int = 20, fallback: bool = False) -> DataFrame | None:
    """Concerns of the best term chunks (place, qualified_name, text). Without a usable answer: None, or one group of all with `fallback`."""
    best = chunks.filter(F.col("place") < most_chunks)
    listing = "\n".join(f"{r.place}: {r.text}" for r in best.select("place", "text").orderBy("place").collect())  # a top-k
    groups = parse_answer(model.complete(f"Group these into 2 to {most} concerns as JSON.\n{listing}\n{query}"))
    if not isinstance(groups, list) or not all(isinstance(g, dict) for g in groups):
        if not fallback:
            return None
        groups = [{"name": query, "description": "", "indices": list(range(most_chunks))}]
    concerns = build_concerns(best, groups, most)
    order = parse_answer(model.complete(f"Rank the concerns as a JSON list of numbers.\n{query}"))
    return rank_concerns(concerns, order if isinstance(order, list) else [])


Embedder = Callable[[list[str]], list[list[float]]]
