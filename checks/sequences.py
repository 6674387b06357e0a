"""Chunks, packed blocks, labels, padding, lengths."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import WORD_IDS_SQL, check, chunks_sql, joined
from checks.vocab import word_ids
from lexmill.functions.tokens import append_eos
from lexmill.operators.sequences import (
    add_labels,
    chunk_tokens,
    pack_blocks,
    pad_batches,
    token_lengths,
)


def eos_ids(spark, folder):
    ids = word_ids(spark, folder)
    return ids.withColumn("input_ids", append_eos(F.col("input_ids")))


@check(
    "q1_chunk_tokens",
    f"""WITH {WORD_IDS_SQL}, {chunks_sql('eos', 32)}
        SELECT doc_id, chunk_no::INTEGER AS chunk_no, array_to_string(ids, ' ') AS ids FROM chunks""",
)
def _(spark, folder):
    chunks = chunk_tokens(eos_ids(spark, folder), 32)
    return chunks.select("doc_id", "chunk_no", joined("input_ids").alias("ids"))


@check(
    "flagship_chunks_per_lang",
    f"""WITH {WORD_IDS_SQL}, {chunks_sql('eos', 32)}
        SELECT lang, count(*) AS n_chunks, sum(len(ids))::BIGINT AS n_tokens,
               sum(list_sum(ids))::BIGINT AS id_sum
        FROM chunks GROUP BY lang""",
)
def flagship(spark, folder):
    """Documents to fixed-size chunks of word ids, summed up per language."""
    chunks = chunk_tokens(eos_ids(spark, folder).select("lang", "input_ids"), 32)
    total = F.aggregate("input_ids", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return chunks.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.sum(F.size("input_ids")).alias("n_tokens"),
        F.sum(total).alias("id_sum"),
    )


def blocks_sql(source: str, block: int, batch: int, part: str = "") -> str:
    """CTE ``blocks`` over a CTE ``source(rank, id, pos)`` of token rows."""
    keys = f"{part}batch_no"
    return f"""
seq AS (SELECT {part}rank // {batch} AS batch_no, id,
               row_number() OVER (PARTITION BY {part}rank // {batch} ORDER BY rank, pos) - 1 AS place,
               count(*) OVER (PARTITION BY {part}rank // {batch}) AS total FROM {source}),
blocks AS (SELECT {keys}, place // {block} AS block_no, list(id ORDER BY place) AS ids FROM seq
           WHERE total < {block} OR place < total - total % {block} GROUP BY ALL)"""


_RANKED_SQL = """
ranked AS (SELECT rank, unnest(ids) AS id, unnest(range(len(ids))) AS pos
           FROM (SELECT ids, row_number() OVER (ORDER BY doc_id) - 1 AS rank FROM eos))"""


@check(
    "q2_pack_blocks",
    f"""WITH {WORD_IDS_SQL}, {_RANKED_SQL}, {blocks_sql('ranked', 1024, 100)}
        SELECT batch_no, block_no, array_to_string(ids, ' ') AS ids FROM blocks""",
)
def _(spark, folder):
    blocks = pack_blocks(eos_ids(spark, folder), 1024, ["doc_id"], batch_rows=100)
    return blocks.select("batch_no", "block_no", joined("input_ids").alias("ids"))


@check(
    "q3_add_labels",
    f"""WITH {WORD_IDS_SQL}, {_RANKED_SQL}, {blocks_sql('ranked', 64, 50)}
        SELECT batch_no, block_no, array_to_string(ids, ' ') AS ids, array_to_string(ids, ' ') AS labels
        FROM blocks""",
)
def _(spark, folder):
    blocks = add_labels(pack_blocks(eos_ids(spark, folder), 64, ["doc_id"], batch_rows=50))
    return blocks.select(
        "batch_no", "block_no", joined("input_ids").alias("ids"), joined("labels").alias("labels")
    )


def _padded_sql(width: str, pad: str, labels: str) -> str:
    return f"""WITH {WORD_IDS_SQL},
        b AS (SELECT doc_id, ids, (row_number() OVER (ORDER BY doc_id) - 1) // 8 AS batch_id FROM eos),
        w AS (SELECT *, {width} AS width FROM (
                SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS longest FROM b)),
        p AS (SELECT *, list_resize(ids, width, 0) AS padded FROM w)
        SELECT doc_id, batch_id, array_to_string(padded, ' ') AS ids,
               array_to_string(list_transform(range(width), lambda i: CASE WHEN i < len(ids) THEN 1 ELSE 0 END), ' ') AS mask,
               array_to_string({labels}, ' ') AS labels
        FROM p"""


def _padded(df):
    return df.select(
        "doc_id",
        "batch_id",
        joined("input_ids").alias("ids"),
        joined("attention_mask").alias("mask"),
        joined("labels").alias("labels"),
    )


@check("q4_pad_batches", _padded_sql("((longest + 7) // 8) * 8", "0", "padded"))
def _(spark, folder):
    batches = pad_batches(eos_ids(spark, folder), 8, ["doc_id"], pad_to_multiple_of=8)
    return _padded(add_labels(batches))


@check(
    "q4_pad_batches_within",
    f"""WITH {WORD_IDS_SQL},
        r AS (SELECT *, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 8 AS batch_id FROM eos),
        w AS (SELECT *, max(len(ids)) OVER (PARTITION BY lang, batch_id) AS width FROM r)
        SELECT lang, doc_id, batch_id, array_to_string(list_resize(ids, width, 0), ' ') AS ids FROM w""",
)
def _(spark, folder):
    """Batches of each language on its own."""
    batches = pad_batches(eos_ids(spark, folder), 8, ["doc_id"], within=["lang"])
    return batches.select("lang", "doc_id", "batch_id", joined("input_ids").alias("ids"))


@check(
    "q5_mask_labels",
    _padded_sql("longest", "0", "list_transform(padded, lambda x: CASE WHEN x = 0 THEN -100 ELSE x END)"),
)
def _(spark, folder):
    return _padded(add_labels(pad_batches(eos_ids(spark, folder), 8, ["doc_id"]), mask=True))


@check(
    "q6_token_lengths",
    f"""WITH {WORD_IDS_SQL}
        SELECT lang, count(*) AS n_rows, sum(len(ids))::BIGINT AS n_tokens, min(len(ids))::INTEGER AS min_len,
               max(len(ids))::INTEGER AS max_len, sum(len(ids))::DOUBLE / count(*) AS avg_len
        FROM eos GROUP BY lang""",
)
def _(spark, folder):
    # the median is approximate by design, so it stays out of the comparison
    return token_lengths(eos_ids(spark, folder), by=["lang"]).drop("median_len")
