"""The engine facade: search, analyse, tiers, ingestion status. Models are pluggable and have plain defaults."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions.text import base_id, search_tokens
from docmill.operators import analyze, keyword, keyword_index, quality, rank, store, usage, vector
from docmill.session import saved, scratch

Embedder = Callable[[list[str]], list[list[float]]]

#: Rulings that a reader gets at a time.
READ_TOGETHER = 50
#: Columns that the keyword search reads.
KEYWORD_COLUMNS = ("caratula", "texto", "tribunal", "materia")


def embed(df: DataFrame, text_col: str, embedder: Embedder, out_col: str = "embedding") -> DataFrame:
    """df with vectors of its texts; the embedder gets whole Arrow batches and is set up once in each worker."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([list(map(float, v)) for v in embedder(texts.fillna("").tolist())])

    return df.withColumn(out_col, run(F.col(text_col)))


def read_each(df: DataFrame, reader: Callable[[pd.DataFrame], pd.DataFrame], schema: str, id_col: str = "id", retries: int = 2) -> DataFrame:
    """A reader's analyses (`schema`) of each ruling, with its id (if it has one) as source_key, an error and the number of attempts.

    The reader gets a batch at a time. Where it fails, each ruling of the batch is read by itself, up to `retries` times more; one that
    fails each time gives a row with the error alone. Attempts count every call a ruling was part of, so that calls which gave nothing are
    paid for as well. Rulings that the reader returns nothing for fall out.
    """
    names = [c.strip().split()[0] for c in _top_level(schema)]
    named = id_col in df.columns
    kind = df.schema[id_col].dataType.simpleString() if named else "string"

    def told(out: pd.DataFrame, key, attempts: int, error: str | None = None) -> pd.DataFrame:
        return out.reindex(columns=names).assign(source_key=key, error=error, attempts=attempts)

    def one(row: pd.DataFrame) -> pd.DataFrame:
        key = row[id_col].iloc[0] if named else None
        for attempt in range(2, retries + 3):
            try:
                return told(reader(row), key, attempt)
            except Exception as e:  # noqa: BLE001  whatever a model's client raises is this ruling's error
                error = f"{type(e).__name__}: {e}"[:200]
        return told(pd.DataFrame([{n: None for n in names}]), key, retries + 2, error)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for start in range(0, len(b), READ_TOGETHER):
                part = b.iloc[start : start + READ_TOGETHER].reset_index(drop=True)
                try:
                    out = reader(part)
                    if len(out) != len(part):
                        raise ValueError("the reader returned other rows than it was given")
                    yield told(out.reset_index(drop=True), part[id_col] if named else None, 1)
                except Exception:  # noqa: BLE001  each ruling by itself
                    for k in range(len(part)):
                        yield one(part.iloc[[k]])

    return df.mapInPandas(run, f"{schema}, source_key {kind}, error string, attempts int")


def _top_level(schema: str) -> list[str]:
    """The fields of a schema in words, commas within types apart."""
    out, depth = [""], 0
    for c in schema:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def read_rulings(df: DataFrame, reader: Callable[[pd.DataFrame], pd.DataFrame], schema: str, id_col: str = "id", retries: int = 2) -> DataFrame:
    """The analyses of read_each() that were got; a ruling whose reader fails is lost alone."""
    return read_each(df, reader, schema, id_col, retries).where("error IS NULL").drop("source_key", "error", "attempts")


def overlap_score(query: str, *columns: str | Column) -> Column:
    """The default reranker: the share of the query's distinct tokens that a passage holds."""
    wanted = F.array_distinct(search_tokens(F.lit(query)))
    own = search_tokens(F.concat_ws(" ", *columns))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(wanted, own)), F.size(wanted)), F.lit(0.0))


def query_text(case: str, fuero: str | None = None, materia: str | None = None) -> str:
    return " ".join([case, *([f"fuero {fuero}"] if fuero else []), *([f"materia {materia}"] if materia else [])])


@dataclass
class Engine:
    """chunks: id, embedding and document columns; documents: id, texto, caratula, ...; fulltext: id, texto.

    keywords: the folder of a keyword index of the documents (keyword_index.build_index over KEYWORD_COLUMNS); without one each search reads the documents.
    """

    spark: SparkSession
    chunks: DataFrame
    documents: DataFrame
    fulltext: DataFrame
    embedder: Embedder
    score: Callable[[str], Column] = field(default=lambda q: overlap_score(q, rank.rerank_passage()))
    least: float | None = rank.THRESHOLD
    keywords: str | None = None

    def search(self, case: str, top_k: int = 10, as_of_year: int = 2024, fix_chunk_ids: bool = True, **conditions) -> DataFrame:
        """The best rulings for a case: vectors and keywords, dedup, rerank, threshold, recency, diversity, full texts."""
        fuero, materia, n = conditions.pop("fuero", None), conditions.pop("materia", None), rank.fetch_size(top_k)
        text = query_text(case, fuero, materia)
        with scratch() as keep:
            near = saved(vector.top_k_rows(self.chunks, self.embedder([text])[0], n, digits=9, materia=materia or fuero, **conditions), "near")
            if near.isEmpty() and (materia or fuero or conditions):
                near = saved(vector.top_k_rows(self.chunks, self.embedder([text])[0], n, digits=9), "near")
            near = near.withColumn("input_rank", F.row_number().over(_by(F.desc_nulls_last("score"), "id")))
            asked = self.spark.createDataFrame([(0, case)], "query_id int, q string")
            if self.keywords:
                hits = keyword_index.search_index(self.spark, self.keywords, asked, n)
            else:  # the same columns as an index has
                hits = keyword.bm25(store.index_rows(self.documents), asked, n, "doc_id", KEYWORD_COLUMNS)
            found = rank.lookup_hits(hits.select(F.col("doc_id").alias("id"), "rank"), self.chunks, fix_chunk_ids=fix_chunk_ids)
            best = rank.funnel(near, found, self.score(text), top_k, as_of_year, self.least)
            best = saved(best, "ranked")
            own = [r[0] for r in best.select(base_id(F.col("id"))).collect()]  # top_k of them at most
            keep(out := saved(store.enrich(best, vector.with_ids(self.fulltext, F.col("id"), own)), "search"))
        return out

    def analyze_stream(self, case: str, reader: Callable[[DataFrame], DataFrame], top_k: int = 30, as_of_year: int = 2024, **options) -> Iterator[tuple[str, DataFrame]]:
        """The steps of analyze() by name as each is done: hits, saving, readings, then what follows from them. A caller that stops early runs no later step."""
        hits = saved(self.search(case, rank.clamp_top_k(top_k), as_of_year, **options), "hits")
        yield "hits", hits
        good, noise = quality.split_quality(hits)
        yield "saving", quality.saving(noise)
        read = saved(reader(good), "readings")
        yield "readings", read
        everything = read.unionByName(quality.auto_inadmissible(noise), allowMissingColumns=True)
        yield "analyses", everything
        for name, f in (("counts", analyze.outcome_counts), ("favourable", analyze.favourable_all)):
            yield name, f(everything)
        for name, f in (("norms", analyze.norm_frequency), ("contradictions", analyze.contradictions)):
            yield name, f(read)
        if {"via_procesal", "doctrina_aplicada", "caratula", "score", "input_rank"} <= set(read.columns):
            yield "strategies", analyze.strategies(read)
        if {"precedentes_citados", "fecha"} <= set(read.columns):
            yield "precedents", analyze.precedents(read, 10, as_of_year)
        yield "synthesis", analyze.fallback_synthesis(everything)

    def analyze(self, case: str, reader: Callable[[DataFrame], DataFrame], top_k: int = 30, **options) -> dict[str, DataFrame]:
        """Analyses of the best rulings and what follows from them; noise is classified without the reader, which sees each ruling once."""
        return dict(self.analyze_stream(case, reader, top_k, **options))

    def tiers(self) -> DataFrame:
        return usage.tiers(self.spark)

    def ingest_status(self) -> DataFrame:
        """Documents and chunks by source."""
        count = lambda df, name: df.groupBy("source").agg(F.count("*").alias(name))
        return count(self.documents, "documents").join(count(self.chunks, "chunks"), "source", "full")


def _by(*order):
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1)).orderBy(*order)
