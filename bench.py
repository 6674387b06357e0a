"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F

from checks import QUERIES
from checks.registry import documents, keep_vocabularies, prefix_vocab, table
from lexmill.operators.cleaning import normalize_text
from lexmill.operators.encode import tokenize
from lexmill.operators.unigram import Model, em_round, word_counts
from lexmill.operators.vocab import char_inventory
from lexmill.session import local_session, materialize, release_scratch

HEADLINE = [
    "flagship_chunks_per_lang",
    "n2_normalize_text",
    "p3_extract_paragraphs",
    "q1_chunk_tokens",
    "q2_pack_blocks",
    "t5_tokens_to_ids",
    "t7_tokenize",
    "t7_tokenize_unspaced",
    "s3_read_csv_blocks",
    "t11_detokenize",
    "u2_shuffle",
    "u5_assign_shards",
    "s5_write_shards",
    "e5_eval_report",
    "e5_eval_report_arrays",
    "t2_train_unigram",
    "f4_build_vocabulary",
    "f1_mixed_token_corpus",
    "f2_mixed_text_corpus",
    "f3_export_corpus",
    "f5_packed_training_set",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus))
    times: dict[str, float] = {}

    def timed(name, action):
        start = time.time()
        out = action()
        times[name] = round(time.time() - start, 3)
        return out

    def drain(df):
        df.write.format("noop").mode("overwrite").save()

    table(spark, folder, "documents").count()  # start the workers
    keep_vocabularies()  # made once, and timed apart from the operators that use it
    timed("setup_prefix_vocabulary", lambda: prefix_vocab(spark, folder).count())
    for name in HEADLINE:
        timed(name, lambda: drain(QUERIES[name](spark, folder)))

    docs = normalize_text(documents(spark, folder).select("doc_id", "text"))
    timed("t1_char_inventory", lambda: drain(char_inventory(docs)))
    words = timed("t2_word_counts", lambda: materialize(word_counts(docs).repartition(int(cpus)), "words"))
    rows = prefix_vocab(spark, folder).filter("kind = 'normal'").toArrow()
    model = Model(rows["piece"].to_pylist(), rows["score"].to_numpy())
    timed("t2_em_round", lambda: em_round(words, model))

    n_docs, n_tokens = (
        tokenize(documents(spark, folder), prefix_vocab(spark, folder))
        .agg(F.count(F.lit(1)), F.sum(F.size("input_ids")))
        .first()
    )
    release_scratch(spark)
    print(
        json.dumps(
            {
                "metric": "total_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(folder).name,
                "docs": n_docs,
                "tokens": n_tokens,
                "docs_per_sec_export": round(n_docs / times["f3_export_corpus"], 1),
                "tokens_per_sec_tokenize": round(n_tokens / times["t7_tokenize"], 1),
            }
        )
    )


if __name__ == "__main__":
    main()
