"""Extraction over recognised blocks: a foreign engine is asked about each block's text, and its answers become entities.

The engine is asked from within tasks, some questions at a time, so a slow answer
holds up none but its own batch. What fails is tried again; what fails for
good is a row with its error, and gives no entities.
"""

from __future__ import annotations

import asyncio
import inspect
from collections.abc import Awaitable, Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orestrata.operators import entities, extraction
from orestrata.sources import reports

Engine = Callable[[str], "str | Awaitable[str]"]

#: What an answer may hold.
ANSWER = f"""struct<locations:array<struct<name:string,location_type:string,coordinates:array<{extraction.COORDINATE}>,county:string,state_province:string,country:string,confidence:double>>,
samples:array<struct<id:string,sample_type:string,depth_from:double,depth_to:double,depth_unit:string,lithology:string,alteration:string,mineralization:string,
 assays:array<struct<element:string,value:double,unit:string,detection_limit:double,confidence:double>>,collection_date:string,confidence:double>>,
geological_observations:array<struct<feature_type:string,description:string,measurements:struct<strike:double,dip:double,trend:double,plunge:double,confidence:double>,
 rock_types:array<string>,minerals:array<string>,confidence:double>>,
document_metadata:map<string,string>,confidence:double>"""


def asked(rows: DataFrame, engine: Engine, text: str = "text", at_once: int = 8, tries: int = 3, wait: float = 0.5, limit: float | None = None) -> DataFrame:
    """``rows`` with the engine's ``answer`` to each row's ``text``, how often it was asked (``asked``), and its last ``error``.

    ``engine`` is a function or a coroutine function of the text; functions run in threads. A task has at most ``at_once``
    questions open and hands its rows on in their order, a batch at a time. A question that fails, or takes longer than
    ``limit`` seconds, is asked again up to ``tries`` times, after ``wait`` seconds and then twice as long each time. A null text isn't asked about.
    """
    schema = T.StructType([*rows.schema.fields, *T._parse_datatype_string("answer string, asked int, error string").fields])
    at = rows.columns.index(text)

    async def one(question: str | None, turn: asyncio.Semaphore) -> tuple[str | None, int, str | None]:
        if question is None:
            return None, 0, None
        error = None
        for k in range(tries):
            try:
                async with turn:
                    reply = engine(question) if inspect.iscoroutinefunction(engine) else asyncio.to_thread(engine, question)
                    return await asyncio.wait_for(reply, limit), k + 1, None
            except Exception as x:  # the engine is foreign code; its failure is data
                error = str(x) or type(x).__name__
            if k + 1 < tries:
                await asyncio.sleep(wait * 2**k)
        return None, tries, error

    async def all_of(questions: list[str | None]) -> list[tuple[str | None, int, str | None]]:
        turn = asyncio.Semaphore(at_once)
        return await asyncio.gather(*(one(q, turn) for q in questions))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with asyncio.Runner() as runner:
            for b in batches:
                replies = list(zip(*runner.run(all_of(b.column(at).to_pylist())))) or [[], [], []]
                more = [pa.array(v, k) for v, k in zip(replies, (pa.string(), pa.int32(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*b.columns, *more], names=schema.names)

    return rows.mapInArrow(run, schema)


@dataclass
class Extracted:
    """Entities by kind, each with ``doc_id``, ``page_id``, ``block_ord``, its number there (``item``) and ``source_text``; the first metadata
    of each document that hold anything; and the blocks that failed."""

    locations: DataFrame
    samples: DataFrame
    observations: DataFrame
    metadata: DataFrame
    failed: DataFrame


def questions(blocks: DataFrame) -> DataFrame:
    """Blocks with text, as the engine is asked about them."""
    return blocks.where(F.trim(F.coalesce("text", F.lit(""))) != "")


def extracted(answered: DataFrame) -> Extracted:
    """Entities of blocks (``doc_id, page_id, block_ord, text, answer, error``) as :func:`asked` gives them.

    Answers are read five times, so they should be written first; an engine isn't asked twice then. An answer that isn't JSON, nor holds
    any, is a failure.
    """
    parsed = reports.answers(answered, "answer", ANSWER)
    here = ["doc_id", "page_id", "block_ord", F.col("text").alias("source_text")]

    def items(kind: str) -> DataFrame:
        return parsed.select(*here, F.posexplode(f"answer.{kind}").alias("item", "x")).select("doc_id", "page_id", "block_ord", "item", "source_text", "x.*")

    places = items("locations").withColumn("location_id", F.struct("page_id", "block_ord", "item"))
    taken = items("samples").withColumnRenamed("id", "sample_id")
    seen = items("geological_observations").select("*", *[F.col(f"measurements.{c}").alias(c) for c in ("strike", "dip", "trend", "plunge")], F.col("measurements.confidence").alias("measurement_confidence")).drop("measurements")
    metadata = extraction.first_metadata(parsed.select("doc_id", "page_id", "block_ord", F.col("answer.document_metadata").alias("metadata")))
    unread = F.col("error").isNull() & F.col("answer_text").isNotNull() & F.col("answer").isNull()
    failed = parsed.withColumn("error", F.when(unread, "the answer isn't JSON").otherwise(F.col("error"))).where(F.col("error").isNotNull())
    return Extracted(extraction.locations(places), extraction.samples(taken), extraction.observations(seen), metadata, failed.select("doc_id", "page_id", "block_ord", "asked", "error"))


def linked(found: Extracted) -> DataFrame:
    """Samples with the first location of their document that stands near them (``linked_id``)."""
    return entities.link_first(found.samples, found.locations)
