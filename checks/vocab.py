"""Vocabulary and tokenisation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from checks.registry import (
    PREFIX_VOCAB_SQL,
    WORD_IDS_SQL,
    WORD_VOCAB_SQL,
    WORDS_SQL,
    check,
    documents,
    joined,
    prefix_vocab,
    table,
    word_docs,
    word_vocab,
)
from lexmill.constants import CHARACTER_COVERAGE, FIRST_LEARNED_ID
from lexmill.functions.tokens import append_eos, ends_with_eos, join_pair, join_pieces
from lexmill.operators.cleaning import normalize_text
from lexmill.operators.encode import detokenize, special_parts, tokenize, tokenize_nbest, tokenize_sampled
from lexmill.operators.ordering import rank_keys, take_first
from lexmill.operators.unigram import (
    Model,
    em_round,
    initial_model,
    repeats,
    seed_pieces,
    substring_counts,
    train_unigram,
    vocabulary_layout,
    word_counts,
)
from lexmill.operators.vocab import (
    add_tokens,
    char_inventory,
    ids_to_tokens,
    reserved_pieces,
    tokens_to_ids,
    training_sample,
    vocab_table,
)
from lexmill.session import materialize, store_result


@check(
    "t1_char_inventory",
    """WITH c AS (
         SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents)
         WHERE ch <> '' GROUP BY ch)
       SELECT ch, n, coalesce(sum(n) OVER (ORDER BY n DESC, ch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
              < (SELECT sum(n) FROM c) * 0.9995::DOUBLE AS kept
       FROM c""",
)
def _(spark, folder):
    return char_inventory(documents(spark, folder))


@check("t2_train_unigram")
def _(spark, folder):
    texts = normalize_text(documents(spark, folder))
    return train_unigram(texts, vocab_size=1000)


# Runs of one kind of character, with a space before them or alone: in these
# texts Latin letters, digits and other signs.
_RUNS_SQL = r"""
runs AS (
  SELECT unnest(regexp_extract_all(replace(text, ' ', '▁'),
    '▁?(?:[\p{Latin}\p{M}]+|\p{N}+|[^\p{L}\p{M}\p{N}▁\n]+)|▁')) AS word
  FROM documents
),
words AS (SELECT word, count(*) AS n FROM runs GROUP BY word),
pieces AS (
  SELECT substr(word, p, k) AS piece, sum(n)::BIGINT AS n
  FROM (SELECT *, unnest(range(2, least(16, length(word) - p + 1) + 1)) AS k
        FROM (SELECT *, unnest(range(1, length(word))) AS p FROM words WHERE length(word) > 1))
  GROUP BY piece HAVING sum(n) >= 2
)"""


def _training_words(spark, folder):
    return word_counts(normalize_text(documents(spark, folder)))


@check("t2_word_counts", f"WITH {_RUNS_SQL} SELECT word, n FROM words")
def _(spark, folder):
    return _training_words(spark, folder)


@check("t2_substring_counts", f"WITH {_RUNS_SQL} SELECT piece, n FROM pieces")
def _(spark, folder):
    return substring_counts(_training_words(spark, folder))


@check(
    "t2_seed_pieces",
    f"""WITH {_RUNS_SQL} SELECT piece, (n * length(piece))::DOUBLE AS worth FROM pieces
        ORDER BY worth DESC, piece LIMIT 5000""",
)
def _(spark, folder):
    return seed_pieces(_training_words(spark, folder), 5000)


_MAXIMAL_SQL = """
extended AS (SELECT substr(piece, 1, length(piece) - 1) AS piece, max(n) AS most FROM pieces WHERE length(piece) > 2 GROUP BY 1),
maximal AS (SELECT p.piece, p.n FROM pieces p LEFT JOIN extended e ON p.piece = e.piece WHERE e.most IS NULL OR p.n > e.most)"""


@check("t2_maximal_repeats", f"WITH {_RUNS_SQL}, {_MAXIMAL_SQL} SELECT piece, n FROM maximal")
def _(spark, folder):
    return repeats(_training_words(spark, folder))


@check(
    "t2_seed_pieces_maximal",
    f"""WITH {_RUNS_SQL}, {_MAXIMAL_SQL} SELECT piece, (n * length(piece))::DOUBLE AS worth FROM maximal
        ORDER BY worth DESC, piece LIMIT 5000""",
)
def _(spark, folder):
    return seed_pieces(_training_words(spark, folder), 5000, maximal=True)


def _required(words, coverage=1.0):
    """The characters of the words with their counts, most frequent first."""
    rows = char_inventory(words.withColumnRenamed("word", "text"), coverage, weight="n").toArrow().to_pylist()
    return {r["ch"]: r["n"] for r in sorted(rows, key=lambda r: (-r["n"], r["ch"])) if r["kept"]}


_CHARS_SQL = "chars AS (SELECT ch, sum(n)::BIGINT AS n FROM (SELECT unnest(string_split(word, '')) AS ch, n FROM words) WHERE ch <> '' GROUP BY ch)"
_DIGAMMA = "ln({0} + 6) - 0.5 / ({0} + 6) - 1 / ({0} + 6) ** 2 * (1.0::DOUBLE / 12 - 1 / ({0} + 6) ** 2 * (1.0::DOUBLE / 120 - 1 / ({0} + 6) ** 2 / 252)) - (" + " + ".join(f"1 / ({{0}} + {i})" for i in range(6)) + ")"


@check(
    "t2_em_round_exact",
    f"""WITH RECURSIVE {_RUNS_SQL}, {_CHARS_SQL},
        worths AS (SELECT ch AS piece, n::DOUBLE AS worth FROM chars
                   UNION ALL (SELECT piece, (n * length(piece))::DOUBLE FROM pieces ORDER BY 2 DESC, piece LIMIT 2000)),
        model AS (SELECT piece, ln(worth) - ln(sum(worth) OVER ()) AS score FROM worths),
        edges AS (
          SELECT word, n, start, k, piece, exp(score) AS p
          FROM (SELECT word, n, start, unnest(range(1, least(16, length(word) - start + 1) + 1)) AS k
                FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS start FROM words)) e
          JOIN model ON piece = substr(word, start, k)),
        into_node AS (SELECT word, start + k - 1 AS node, list({{'k': k, 'p': p}}) AS l FROM edges GROUP BY ALL),
        from_node AS (SELECT word, start, list({{'k': k, 'p': p}}) AS l FROM edges GROUP BY ALL),
        ways AS (SELECT word, i.l AS i, f.l AS f FROM
                 (SELECT word, list(l ORDER BY node) AS l FROM into_node GROUP BY word) i
                 JOIN (SELECT word, list(l ORDER BY start DESC) AS l FROM from_node GROUP BY word) f USING (word)),
        -- the sums into each node from the front and from the back, one node a step
        sums AS (
          SELECT word, i, f, 0 AS node, [1.0::DOUBLE] AS a, [1.0::DOUBLE] AS b FROM ways
          UNION ALL
          SELECT word, i, f, node + 1,
                 list_append(a, list_sum(list_transform(i[node + 1], lambda x: a[node + 2 - x.k] * x.p))),
                 list_append(b, list_sum(list_transform(f[node + 1], lambda x: b[node + 2 - x.k] * x.p)))
          FROM sums WHERE node < len(i)),
        expected AS (
          SELECT piece, sum(round(a[start] * p * b[len(i) - start - k + 2] / a[len(a)] * n * 1048576)) / 1048576 AS c
          FROM edges JOIN (SELECT * FROM sums WHERE node = len(i)) USING (word) GROUP BY piece),
        kept AS (SELECT piece, c, sum(c) OVER () AS total FROM expected WHERE c >= 0.5)
        SELECT piece, round({_DIGAMMA.format('c')} - ({_DIGAMMA.format('total')}), 4) AS score FROM kept""",
)
def _(spark, folder):
    """Every segmentation of every word, summed up exactly."""
    words = materialize(_training_words(spark, folder), "words")
    model = em_round(words, initial_model(_required(words), seed_pieces(words, 2000).toArrow()))
    table = pa.table({"piece": model.pieces, "score": model.scores})
    return spark.createDataFrame(table).select("piece", F.round("score", 4).alias("score"))


_RESERVED_SQL = "SELECT unnest(range(8))::INTEGER AS id, unnest(['<pad>', '<s>', '</s>', '<unk>', '[SEP]', '[CLS]', '[MASK]', '<n>']) AS piece, 0.0::DOUBLE AS score, unnest(['control', 'control', 'control', 'unknown', 'control', 'control', 'control', 'user']) AS kind"


def required_only_sql(source: str) -> str:
    """The vocabulary of characters alone over a table of texts: one segmentation each."""
    return f"""WITH documents_ AS ({source}),
        c AS (SELECT ch, count(*) AS n FROM (
                SELECT unnest(string_split(replace(replace(text, chr(10), ''), ' ', '▁'), '')) AS ch FROM documents_) WHERE ch <> '' GROUP BY ch),
        o AS (SELECT *, coalesce(sum(n) OVER (ORDER BY n DESC, ch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS total FROM c),
        k AS (SELECT ch, n::DOUBLE AS n, (sum(n) OVER ())::DOUBLE AS total FROM o WHERE before < total * 0.9995::DOUBLE)
        {_RESERVED_SQL}
        UNION ALL
        SELECT (7 + row_number() OVER (ORDER BY n DESC, ch))::INTEGER, ch, round({_DIGAMMA.format('n')} - ({_DIGAMMA.format('total')}), 6), 'normal' FROM k"""


def characters_kept(words) -> int:
    return len(_required(words, CHARACTER_COVERAGE))


@check("t2_required_only", required_only_sql("SELECT text FROM documents"))
def _(spark, folder):
    texts = normalize_text(documents(spark, folder))
    size = FIRST_LEARNED_ID + characters_kept(word_counts(texts))
    return train_unigram(texts, size, longest=1).withColumn("score", F.round("score", 6))


@check(
    "t2_vocabulary_layout",
    f"""WITH {_RUNS_SQL}, {_CHARS_SQL},
        scored AS (SELECT ch AS piece, round(ln(n), 6) AS score FROM chars WHERE n >= 1000
                   UNION ALL (SELECT piece, round(ln(n), 6) FROM pieces ORDER BY n DESC, piece LIMIT 3000)),
        required AS (
          SELECT ch AS piece, coalesce(s.score, (SELECT min(score) FROM scored) - 0.0001::DOUBLE * (row_number() OVER (ORDER BY n DESC, ch) - 1)) AS score
          FROM chars c LEFT JOIN scored s ON c.ch = s.piece),
        others AS (SELECT piece, score FROM scored WHERE piece NOT IN (SELECT piece FROM required)
                   ORDER BY score DESC, piece LIMIT (SELECT 1992 - count(*) FROM required))
        {_RESERVED_SQL}
        UNION ALL
        SELECT (7 + row_number() OVER (ORDER BY score DESC, piece))::INTEGER, piece, score, 'normal'
        FROM (SELECT * FROM required UNION ALL SELECT * FROM others)""",
)
def _(spark, folder):
    """Characters that the model keeps, characters that it lost, and the best of its pieces."""
    words = materialize(_training_words(spark, folder), "words")
    required = _required(words)
    found = take_first(materialize(repeats(words, maximal=False), "pieces"), 3000, ["-n", "piece"]).toArrow().to_pylist()
    scored = {c: n for c, n in required.items() if n >= 1000} | {r["piece"]: r["n"] for r in found}
    model = Model(list(scored), np.round(np.log(np.array(list(scored.values()), dtype=float)), 6))
    return vocabulary_layout(spark, model, required, 2000)


@check(
    "t3_training_sample",
    """SELECT conv_id, turn, text FROM conversations
       WHERE strlen(text) <= 600 AND text <> '' ORDER BY conv_id, turn LIMIT 700""",
)
def _(spark, folder):
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "text")
    return training_sample(turns, ["conv_id", "turn"], sentences=700, max_bytes=600)


@check(
    "t4_vocab_table",
    f"""WITH {WORDS_SQL}, {WORD_VOCAB_SQL}
        SELECT id::INTEGER AS id, CASE WHEN piece = '<n>' THEN chr(10) ELSE piece END AS surface,
               CASE WHEN id = 3 THEN 'unknown' WHEN id < 7 THEN 'control'
                    WHEN id = 7 THEN 'user' ELSE 'normal' END AS kind
        FROM vocab""",
)
def _(spark, folder):
    return vocab_table(word_vocab(word_docs(spark, folder)))


def word_ids(spark, folder, **options):
    docs = word_docs(spark, folder)
    return tokens_to_ids(docs, word_vocab(docs), **options)


_IDS = "array_to_string(ids, ' ') AS ids"


@check("t5_tokens_to_ids", f"WITH {WORD_IDS_SQL} SELECT doc_id, {_IDS} FROM ids")
def _(spark, folder):
    return word_ids(spark, folder).select("doc_id", joined("input_ids").alias("ids"))


@check("t5_tokens_to_ids_by_join", f"WITH {WORD_IDS_SQL} SELECT doc_id, {_IDS} FROM ids")
def _(spark, folder):
    ids = word_ids(spark, folder, limit=100)
    return ids.select("doc_id", joined("input_ids").alias("ids"))


@check(
    "t5_tokens_to_ids_by_join_repeated_keys",
    f"WITH {WORD_IDS_SQL} SELECT 1 AS one, {_IDS} FROM ids UNION ALL SELECT 1, {_IDS} FROM ids WHERE lang = 'en'",
)
def _(spark, folder):
    docs = word_docs(spark, folder)
    rows = docs.union(docs.filter("lang = 'en'")).withColumn("one", F.lit(1)).select("one", "tokens")
    return tokens_to_ids(rows, word_vocab(docs), limit=100).select("one", joined("input_ids").alias("ids"))


_BACK_SQL = f"""WITH {WORD_IDS_SQL},
back AS (SELECT doc_id, string_agg(CASE WHEN piece = '<n>' THEN chr(10) ELSE piece END, ' '
                                   ORDER BY pos) AS tokens
         FROM tok JOIN vocab USING (id) GROUP BY doc_id)
SELECT doc_id, coalesce(tokens, '') AS tokens FROM documents LEFT JOIN back USING (doc_id)"""


@check("t6_ids_to_tokens", _BACK_SQL)
def _(spark, folder):
    docs = word_docs(spark, folder)
    vocab = word_vocab(docs)
    ids = tokens_to_ids(docs, vocab)
    back = ids_to_tokens(ids, vocab)
    return back.select("doc_id", joined("tokens").alias("tokens"))


@check("t6_ids_to_tokens_by_join", _BACK_SQL)
def _(spark, folder):
    docs = word_docs(spark, folder)
    vocab = word_vocab(docs)
    ids = tokens_to_ids(docs, vocab)
    back = ids_to_tokens(ids, vocab, limit=100)
    return back.select("doc_id", joined("tokens").alias("tokens"))


@check(
    "t7_tokenize",
    f"""WITH {PREFIX_VOCAB_SQL}
        SELECT doc_id, array_to_string(list_append(coalesce(ids, []), 2), ' ') AS ids
        FROM documents LEFT JOIN enc USING (doc_id)""",
)
def _(spark, folder):
    ids = tokenize(documents(spark, folder), prefix_vocab(spark, folder))
    return ids.select("doc_id", joined("input_ids").alias("ids"))


_DIGRAM = "[bcdfghjklmnpqrstvwxz][aeiou]"
_UNSPACED = "replace(replace(text, ' ', ''), chr(10), '')"


@check(
    "t7_tokenize_unspaced",
    f"""WITH u AS (SELECT doc_id, {_UNSPACED} AS text FROM documents),
        cut AS (SELECT doc_id, unnest(t) AS piece, unnest(range(len(t))) AS pos
                FROM (SELECT doc_id, regexp_extract_all(text, '(?s){_DIGRAM}|.') AS t FROM u)),
        known AS (
          SELECT piece, 7 + row_number() OVER (ORDER BY part, piece) AS id FROM (
            SELECT DISTINCT 0 AS part, unnest(string_split(text, '')) AS piece FROM u
            UNION SELECT 1, unnest(regexp_extract_all(text, '{_DIGRAM}')) FROM u) WHERE piece <> ''),
        enc AS (SELECT doc_id, list(id ORDER BY pos) AS ids FROM cut JOIN known USING (piece) GROUP BY doc_id)
        SELECT doc_id, array_to_string(list_append(coalesce(ids, []), 2), ' ') AS ids FROM documents LEFT JOIN enc USING (doc_id)""",
)
def _(spark, folder):
    """Whole texts without a blank: letters, and pairs of letters that never overlap."""
    return tokenize(*_unspaced(spark, folder)).select("doc_id", joined("input_ids").alias("ids"))


def _unspaced(spark, folder):
    text = F.replace(F.replace("text", F.lit(" "), F.lit("")), F.lit("\n"), F.lit(""))
    docs = materialize(documents(spark, folder).select("doc_id", text.alias("text")), "unspaced")
    letters = docs.select(F.lit(0).alias("part"), F.explode(F.array_distinct(F.split("text", ""))).alias("piece"))
    found = F.regexp_extract_all("text", F.lit(_DIGRAM), F.lit(0))
    pairs = docs.select(F.lit(1).alias("part"), F.explode(F.array_distinct(found)).alias("piece"))
    ranked = rank_keys(letters.unionByName(pairs).filter("piece <> ''").distinct(), ["part", "piece"], [], "place")
    learned = ranked.select(
        (F.col("place") + FIRST_LEARNED_ID).cast("int").alias("id"), "piece",
        F.when(F.col("part") == 1, -1.0).otherwise(-10.0).alias("score"), F.lit("normal").alias("kind"),
    )
    return docs, materialize(reserved_pieces(spark).unionByName(learned), "pair-vocabulary")


# Splitting one pair costs 19, so the best way is followed by as many equal ones as there are pairs.
@check(
    "t7_tokenize_nbest",
    f"""WITH u AS (SELECT doc_id, {_UNSPACED} AS text FROM documents),
        c AS (SELECT doc_id, length(text) AS n, len(regexp_extract_all(text, '{_DIGRAM}')) AS pairs FROM u),
        r AS (SELECT *, unnest([1, 2, 3])::INTEGER AS place FROM c)
        SELECT doc_id, place, round(-10.0::DOUBLE * n + 19 * pairs - CASE WHEN place > 1 THEN 19 ELSE 0 END, 6) AS score,
               (n - pairs + CASE WHEN place > 1 THEN 1 ELSE 0 END)::INTEGER AS n_ids
        FROM r WHERE place = 1 OR place <= pairs + 1""",
)
def _(spark, folder):
    """The three best ways through whole texts."""
    ways = tokenize_nbest(*_unspaced(spark, folder), 3).select("doc_id", F.posexplode("ways").alias("place", "way"))
    return ways.select("doc_id", (F.col("place") + 1).alias("place"), F.round("way.score", 6).alias("score"), F.size("way.input_ids").alias("n_ids"))


@check(
    "t7_tokenize_sampled",
    "SELECT lang, count(*) AS n_docs, count(*) AS n_same_text, count(*) FILTER (strlen(text) > 100) AS n_more_ids FROM documents GROUP BY lang",
)
def _(spark, folder):
    """Segmentations drawn by chance spell the same texts, with more ids than the best.

    Only the ids are moved once; the joins after that move their numbers, and texts as SHA-256."""
    docs, vocab = documents(spark, folder), prefix_vocab(spark, folder)

    def segmented():
        best = tokenize(docs, vocab, add_special_tokens=False).select("doc_id", "lang", F.col("input_ids").alias("best"))
        drawn = tokenize_sampled(docs.select("doc_id", "text"), vocab, ["doc_id"], alpha=0.0)
        return best.join(drawn, "doc_id")

    both = store_result(spark, segmented, "drawn")

    def spelled(ids, name):
        def digests():
            texts = detokenize(both.select("doc_id", F.col(ids).alias("input_ids")), vocab)
            return texts.select("doc_id", F.unhex(F.sha2("text", 256)).alias(name))

        return store_result(spark, digests, name)

    one, two = spelled("input_ids", "one"), spelled("best", "two")
    sizes = both.select("doc_id", "lang", F.size("input_ids").alias("n_drawn"), F.size("best").alias("n_best"))
    long = sizes.join(docs.select("doc_id", F.octet_length("text").alias("n")), "doc_id").join(one, "doc_id").join(two, "doc_id")
    return long.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("one") == F.col("two")).alias("n_same_text"),
        F.count_if((F.col("n") > 100) & (F.col("n_drawn") > F.col("n_best"))).alias("n_more_ids"),
    )


_FREQUENT = """SELECT w FROM (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS w FROM documents)
               WHERE regexp_full_match(w, '[a-z]{4,}') GROUP BY w ORDER BY count(*) DESC, w LIMIT 500"""


@check(
    "t8_added_tokens",
    f"""WITH tokens AS ({_FREQUENT}),
        pattern AS (SELECT string_agg(w, '|' ORDER BY length(w) DESC, w) AS p FROM tokens)
        SELECT token, count(*) AS n, count(DISTINCT doc_id) AS n_docs
        FROM (SELECT doc_id, unnest(regexp_extract_all(text, p)) AS token FROM documents, pattern) GROUP BY token""",
)
def _(spark, folder):
    """500 added tokens, many of which begin alike or lie in one another, found in whole texts."""
    docs = documents(spark, folder)
    words = docs.select(F.explode(F.split("text", "[ \\t\\n\\f\\r]+")).alias("w")).filter(F.col("w").rlike("^[a-z]{4,}$"))
    tokens = [r["w"] for r in words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(500).collect()]
    plain = prefix_vocab(spark, folder)
    vocab = add_tokens(plain, tokens)
    ids = tokenize(docs.select("doc_id", "text"), vocab).select("doc_id", F.explode("input_ids").alias("id"))
    names = vocab.filter("kind = 'added'").select("id", F.col("piece").alias("token"))
    return ids.join(F.broadcast(names), "id").groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs")
    )


@check(
    "t8_special_parts",
    """WITH b AS (
         SELECT doc_id, '<s>[CLS] ' || lang || ' [SEP]' || replace(text, '.', '. [MASK] ') || '</s>' AS t
         FROM documents),
       p AS (
         SELECT doc_id, unnest(ps) AS p, unnest(range(len(ps))) AS k FROM (
           SELECT doc_id, string_split(regexp_replace(t, '(<s>|</s>|\\[CLS\\]|\\[SEP\\]|\\[MASK\\])',
                                       '@@@\\1@@@', 'g'), '@@@') AS ps FROM b))
       SELECT doc_id, string_agg(q, '|' ORDER BY k) AS parts FROM (
         SELECT doc_id, k, replace(trim(p, E' \\n'), chr(10), '<n>') AS q FROM p)
       WHERE q <> '' GROUP BY doc_id""".replace("\\\\", "\\"),
)
def _(spark, folder):
    masked = F.replace("text", F.lit("."), F.lit(". [MASK] "))
    text = F.concat(F.lit("<s>[CLS] "), "lang", F.lit(" [SEP]"), masked, F.lit("</s>"))
    built = documents(spark, folder).select("doc_id", text.alias("text"))
    return built.select("doc_id", F.array_join(special_parts(F.col("text")), "|").alias("parts"))


@check(
    "t9_append_eos",
    f"""WITH {WORD_IDS_SQL},
        cut AS (SELECT doc_id, ids FROM ids UNION ALL SELECT doc_id, list_append(ids, 2) FROM ids
                UNION ALL SELECT doc_id, [] FROM ids),
        closed AS (SELECT doc_id, len(ids) > 0 AND ids[len(ids)] = 2 AS had_eos, ids FROM cut)
        SELECT doc_id, had_eos,
               array_to_string(CASE WHEN had_eos THEN ids ELSE list_append(ids, 2) END, ' ') AS ids,
               array_to_string(list_concat(CASE WHEN had_eos THEN ids ELSE list_append(ids, 2) END, [9, 8, 2]), ' ') AS pair
        FROM closed""",
)
def _(spark, folder):
    ids = F.col("input_ids")
    plain = word_ids(spark, folder).select("doc_id", "input_ids")
    closed = plain.withColumn("input_ids", F.concat(ids, F.array(F.lit(2))))
    empty = plain.withColumn("input_ids", F.array().cast("array<int>"))
    df = plain.union(closed).union(empty)
    other = F.array(F.lit(9), F.lit(8))
    return df.select(
        "doc_id",
        ends_with_eos(ids).alias("had_eos"),
        joined(append_eos(ids)).alias("ids"),
        joined(join_pair(ids, other)).alias("pair"),
    )


@check(
    "t10_tokenize_without_specials",
    f"""WITH {PREFIX_VOCAB_SQL}
        SELECT doc_id, array_to_string(coalesce(ids, []), ' ') AS ids
        FROM documents LEFT JOIN enc USING (doc_id)""",
)
def _(spark, folder):
    ids = tokenize(
        documents(spark, folder), prefix_vocab(spark, folder), add_special_tokens=False
    )
    return ids.select("doc_id", joined("input_ids").alias("ids"))


# Every fifth word becomes a special token, every other one starts with a space.
@check(
    "t11_join_pieces",
    f"""WITH {WORDS_SQL},
        p AS (SELECT doc_id, pos, pos % 5 IN (0, 4) AS special,
                     CASE pos % 5 WHEN 0 THEN '</s>' WHEN 4 THEN '[SEP]' WHEN 1 THEN w ELSE ' ' || w END AS t
              FROM words),
        r AS (SELECT *, coalesce(sum(special::INT) OVER (PARTITION BY doc_id ORDER BY pos
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM p),
        g AS (SELECT doc_id, run, bool_or(special) AS closed, count(*) FILTER (NOT special) AS n,
                     ltrim(coalesce(string_agg(t, '' ORDER BY pos) FILTER (NOT special), ''), ' ') AS body,
                     coalesce(max(t) FILTER (special), '') AS mark
              FROM r GROUP BY doc_id, run)
        SELECT doc_id, trim(string_agg(CASE WHEN closed AND (n > 0 OR run = 0) THEN ' ' ELSE '' END
                            || body || mark, '' ORDER BY run), ' ') AS text
        FROM g GROUP BY doc_id""",
)
def _(spark, folder):
    pieces = F.transform(
        "tokens",
        lambda w, i: F.when(i % 5 == 0, "</s>")
        .when(i % 5 == 4, "[SEP]")
        .when(i % 5 == 1, w)
        .otherwise(F.concat(F.lit("▁"), w)),
    )
    docs = word_docs(spark, folder).filter(F.size("tokens") > 0)
    return docs.select("doc_id", join_pieces(pieces).alias("text"))


@check(
    "t11_detokenize",
    "SELECT doc_id, text || '</s>' AS text FROM documents",
)
def _(spark, folder):
    vocab = prefix_vocab(spark, folder)
    ids = tokenize(documents(spark, folder).select("doc_id", "text"), vocab)
    return detokenize(ids, vocab)
