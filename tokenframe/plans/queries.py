"""The registered queries of the tokenization engine, each with its SQL where SQL can say it.

A query reads whole tables. Lists come out as their length and an MD5 of their joined elements.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.grammars import EXHAUSTIVE, GRAMMARS
from ..functions.pretokenizers import BYTE_CHAR
from ..operators import arrow
from ..sources import corpus, samples
from ..sources.spec import TokenizerSpec
from ..streaming.decode import decode_stream, replay
from . import relational
from .engine import Engine
from .storage import shared_folder, spread, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SEP = chr(31)


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return register


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang"), "doc_id")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def digest(df: DataFrame, items: Column, key: str = "doc_id", sep: str = SEP) -> DataFrame:
    own = df.select(key, items.alias("items"))
    return own.select(key, F.size("items").cast("long").alias("n"), F.md5(F.array_join(F.transform("items", lambda x: x.cast("string")), sep).cast("binary")).alias("digest"))


def sql_digest(items: str, source: str = "documents", key: str = "doc_id", sep: str = SEP) -> str:
    return f"SELECT {key}, CAST(len(items) AS BIGINT) AS n, md5(array_to_string(items, '{sep}')) AS digest FROM (SELECT {key}, {items} AS items FROM {source})"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# pre-tokenizers

query("SELECT doc_id, CAST(len(items) AS BIGINT) AS n, md5(array_to_string(items, chr(31))) AS digest FROM (SELECT doc_id, regexp_extract_all(text, '\\S+') AS items FROM documents)", "whitespace_split")(lambda spark, d: digest(docs(spark, d), C.whitespace_split(F.col("text"))))

MARKED = "(SELECT doc_id, CASE WHEN starts_with(m, '▁') THEN m ELSE '▁' || m END AS m FROM (SELECT doc_id, replace(text, ' ', '▁') AS m FROM documents))"
query(sql_digest("regexp_extract_all(m, '▁[^▁]*|[^▁]+')", MARKED), "metaspace_pieces")(lambda spark, d: digest(docs(spark, d), C.metaspace(F.col("text"))))


@query(f"WITH p AS (SELECT doc_id, regexp_extract_all(m, '▁[^▁]*|[^▁]+') AS items FROM {MARKED}) SELECT doc_id, md5(replace(items[1], '▁', '') || replace(array_to_string(items[2:], ''), '▁', ' ')) AS digest FROM p")
def metaspace_roundtrip(spark, sf_dir):
    pieces = C.let(C.metaspace(F.col("text")), lambda p: C.metaspace_decode(p))
    return docs(spark, sf_dir).select("doc_id", F.md5(pieces.cast("binary")).alias("digest"))


DELIMITER = "[0-9]+|[,.]"
MARKS = {
    "Removed": "regexp_replace(text, '{p}', chr(1), 'g')", "Isolated": "regexp_replace(text, '({p})', chr(1) || '\\1' || chr(1), 'g')",
    "MergedWithPrevious": "regexp_replace(text, '({p})', '\\1' || chr(1), 'g')", "MergedWithNext": "regexp_replace(text, '({p})', chr(1) || '\\1', 'g')",
    "Contiguous": "replace(regexp_replace(text, '({p})', chr(1) || '\\1' || chr(1), 'g'), chr(1) || chr(1), '')",
}


def sql_split(behavior: str, pattern: str) -> str:
    return f"list_filter(string_split({MARKS[behavior].format(p=pattern)}, chr(1)), lambda x: x <> '')"


def _split_query(behavior: str, name: str) -> None:
    query(sql_digest(sql_split(behavior, DELIMITER)), f"split_{name}")(lambda spark, d: digest(docs(spark, d), C.split(F.col("text"), DELIMITER, behavior)))


for _b, _n in (("Removed", "removed"), ("Isolated", "isolated"), ("MergedWithPrevious", "merged_with_previous"), ("MergedWithNext", "merged_with_next"), ("Contiguous", "contiguous")):
    _split_query(_b, _n)

query(sql_digest(f"regexp_extract_all(text, '{DELIMITER}')"), "split_removed_inverted")(lambda spark, d: digest(docs(spark, d), C.split(F.col("text"), DELIMITER, "Removed", True)))
query(sql_digest(sql_split("MergedWithNext", DELIMITER)), "split_merged_with_previous_inverted")(lambda spark, d: digest(docs(spark, d), C.split(F.col("text"), DELIMITER, "MergedWithPrevious", True)))
query(sql_digest(sql_split("Isolated", r"\. ")), "split_literal")(lambda spark, d: digest(docs(spark, d), C.split(F.col("text"), ". ", "Isolated", literal=True)))
query(sql_digest("CASE WHEN text = '' THEN [] ELSE [text] END"), "split_empty_literal")(lambda spark, d: digest(docs(spark, d), C.split(F.col("text"), "", "Isolated", literal=True)))


def _arrow_pieces(df: DataFrame, spec: TokenizerSpec) -> DataFrame:
    return digest(df, F.transform(arrow.pieces(F.col("text"), spec), lambda p: p["text"]))


@query(sql_digest("list_filter(string_split(regexp_replace(text, '([A-Z])', chr(1) || '\\1', 'g'), chr(1)), lambda x: x <> '')"))
def split_zero_width(spark, sf_dir):
    return _arrow_pieces(docs(spark, sf_dir), samples.minimal(pre_tokenizer={"type": "Split", "pattern": {"Regex": "(?=[A-Z])"}, "behavior": "Isolated", "invert": False}))


@query(sql_digest("flatten(list_transform(regexp_extract_all(text, '\\S+'), lambda w: list_filter(string_split(regexp_replace(w, '([0-9])', chr(1) || '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')))"))
def pre_tokenizer_sequence(spark, sf_dir):
    steps = [{"type": "WhitespaceSplit"}, {"type": "Split", "pattern": {"Regex": "[0-9]"}, "behavior": "Isolated", "invert": False}]
    pieces = Engine(samples.minimal(pre_tokenizer={"type": "Sequence", "pretokenizers": steps})).pieces(F.col("text"))
    return digest(docs(spark, sf_dir), F.transform(pieces, lambda p: p["text"]))


# named grammars; RE2 has no look-ahead: a mark before the last character of each space run stands for it


def sql_grammar(name: str, text: str = "text") -> str:
    p = GRAMMARS[name].replace(r"\s+(?!\S)|", "").replace("[^\\s", "[^\\s\\x01").replace(r"&&[^\p{Han}]", "")
    last = r"[^\S\r\n]" if r"\s*[\r\n]+" in p else r"\s"
    marked = f"regexp_replace({text}, '(\\s+)({last})(\\S)', '\\1' || chr(1) || '\\2\\3', 'g')"
    if name in EXHAUSTIVE:
        return f"regexp_extract_all({marked}, {q(p)})"
    return f"list_filter(list_transform(string_split(regexp_replace({marked}, {q(f'({p})')}, chr(30) || '\\1' || chr(30), 'g'), chr(30)), lambda x: replace(x, chr(1), '')), lambda x: x <> '')"


def _grammar_query(name: str) -> None:
    query(sql_digest(sql_grammar(name)), f"grammar_{name}")(lambda spark, d: digest(docs(spark, d), C.grammar(F.col("text"), name)))


for _n in GRAMMARS:
    _grammar_query(_n)

CHAIN = ("deepseek_number", "deepseek_cjk", "deepseek_main")
_chain_sql = "text"
for _n in CHAIN:
    _chain_sql = sql_grammar(_n) if _n == CHAIN[0] else f"flatten(list_transform({_chain_sql}, lambda y{_n[9]}: {sql_grammar(_n, f'y{_n[9]}')}))"


@query(sql_digest(_chain_sql))
def grammar_deepseek_chain(spark, sf_dir):
    steps = [{"type": "Split", "pattern": {"Regex": GRAMMARS[n]}, "behavior": "Isolated", "invert": False} for n in CHAIN]
    pieces = Engine(samples.minimal(pre_tokenizer={"type": "Sequence", "pretokenizers": steps})).pieces(F.col("text"))
    return digest(docs(spark, sf_dir), F.transform(pieces, lambda p: p["text"]))


GPT2 = sql_grammar("gpt2")
query(sql_digest(f"list_transform({GPT2}, lambda p: hex(encode(p)))"), "byte_level_hex")(lambda spark, d: digest(docs(spark, d), F.transform(C.grammar(F.col("text"), "gpt2"), C.byte_hex)))
query(f"SELECT piece, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest({GPT2}) AS piece FROM documents) GROUP BY piece ORDER BY n DESC, piece LIMIT 100", "gpt2_piece_topk")(lambda spark, d: relational.top_pieces(docs(spark, d), C.grammar(F.col("text"), "gpt2"), 100))


def _unspelled(piece: Column) -> Column:
    """The bytes, in hex, that a byte-level piece spells: each character becomes U+0100 and its byte, whose
    UTF-16 is 01 and the byte."""
    bytes_ = F.translate(piece, "".join(BYTE_CHAR.values()), "".join(chr(256 + b) for b in BYTE_CHAR))
    return F.regexp_replace(F.hex(F.encode(bytes_, "UTF-16BE")), "01(..)", "$1")


@query(sql_digest(f"list_transform({GPT2.replace('(text', '(t')}, lambda p: hex(encode(p)))", "(SELECT doc_id, CASE WHEN text = '' OR starts_with(text, ' ') THEN text ELSE ' ' || text END AS t FROM documents)"))
def byte_level_prefix_space_hex(spark, sf_dir):
    """All texts; pieces come out as the bytes they spell."""
    pieces = arrow.pieces(F.col("text"), samples.byte_bpe(prefix=True))
    return digest(docs(spark, sf_dir), F.transform(pieces, lambda p: _unspelled(p["text"])))


# normalizers

query("SELECT doc_id, md5(replace(text, 'the', 'θ')) AS digest FROM documents", "replace_literal")(lambda spark, d: _md5(spark, d, C.replace_literal(F.col("text"), "the", "θ")))
query("SELECT doc_id, md5(regexp_replace(text, '[0-9]+', '$1', 'g')) AS digest FROM documents", "replace_regex_literal_dollar")(lambda spark, d: _md5(spark, d, C.replace_regex(F.col("text"), "[0-9]+", "$1")))
query("SELECT doc_id, md5('-' || array_to_string(list_transform(regexp_extract_all(text, '(?s).'), lambda c: c || '-'), '')) AS digest FROM documents", "replace_empty_needle")(lambda spark, d: _md5(spark, d, C.replace_literal(F.col("text"), "", "-")))


def _md5(spark: SparkSession, sf_dir: str, text: Column) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.md5(text.cast("binary")).alias("digest"))


@query("SELECT doc_id, md5(nfc_normalize(replace(text, 'é', 'e' || chr(769)))) AS digest FROM documents")
def nfc_normalize(spark, sf_dir):
    apart = docs(spark, sf_dir).withColumn("text", F.replace("text", F.lit("é"), F.lit("é")))
    return apart.select("doc_id", F.md5(Engine(samples.minimal(normalizer={"type": "NFC"})).normalized(F.col("text")).cast("binary")).alias("digest"))


_folded = "text"
for _a, _b in samples.FOLDS.items():
    _folded = f"replace({_folded}, '{_a}', '{_b}')"


@query(f"SELECT doc_id, md5({_folded}) AS digest FROM documents")
def precompiled_charsmap(spark, sf_dir):
    return _md5(spark, sf_dir, Engine(samples.folding()).normalized(F.col("text")))


@query("SELECT doc_id, md5(replace(regexp_replace(text, '[0-9]', '#', 'g'), '##', '#')) AS digest FROM documents")
def normalizer_sequence(spark, sf_dir):
    steps = [{"type": "Replace", "pattern": {"Regex": "[0-9]"}, "content": "#"}, {"type": "Replace", "pattern": {"String": "##"}, "content": "#"}]
    return _md5(spark, sf_dir, Engine(samples.minimal(normalizer={"type": "Sequence", "normalizers": steps})).normalized(F.col("text")))


# added tokens

ADDED = {"the": 1, "then": 2, "in": 3, "ing": 4}


def _segment_digest(df: DataFrame, segments: Column) -> DataFrame:
    return digest(df, F.transform(segments, lambda s: F.concat_ws(":", s["token_id"].cast("string"), s["text"])))


_numbered = "list_transform({x}, lambda s: CASE s WHEN 'the' THEN '1:the' WHEN 'then' THEN '2:then' WHEN 'in' THEN '3:in' WHEN 'ing' THEN '4:ing' ELSE s END)"
_segments_sql = sql_digest(_numbered.format(x="list_filter(string_split(regexp_replace(text, '(then|ing|the|in)', chr(1) || '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"))
query(_segments_sql, "added_token_segments_catalyst")(lambda spark, d: _segment_digest(docs(spark, d), C.segments(F.col("text"), ADDED)))


def _added(**flags) -> list[dict]:
    return [{"id": i, "content": t} | flags for t, i in ADDED.items()]


query(_segments_sql, "added_token_segments")(lambda spark, d: _segment_digest(docs(spark, d), arrow.segments(F.col("text"), samples.minimal(added_tokens=_added()))))


@query(sql_digest("list_filter(string_split(regexp_replace(text, '(\\s*(?:then|ing|the|in)\\s*)', chr(1) || '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"))
def added_token_strip(spark, sf_dir):
    got = arrow.segments(F.col("text"), samples.minimal(added_tokens=_added(lstrip=True, rstrip=True)))
    return digest(docs(spark, sf_dir), F.transform(got, lambda s: s["text"]))


@query("SELECT doc_id, CAST(len(list_filter(regexp_extract_all(text, '[\\p{L}\\p{M}\\p{N}_]+'), lambda w: w = 'the')) AS BIGINT) AS n FROM documents")
def added_token_single_word(spark, sf_dir):
    got = arrow.segments(F.col("text"), samples.minimal(added_tokens=[{"id": 1, "content": "the", "single_word": True}]))
    return docs(spark, sf_dir).select("doc_id", F.size(F.filter(got, lambda s: s["token_id"] == 1)).cast("long").alias("n"))


@query("SELECT doc_id, CAST((length(t) - length(replace(t, 'xhe', ''))) // 3 AS BIGINT) AS n FROM (SELECT doc_id, replace(text, 't', 'x') AS t FROM documents)")
def added_token_normalized(spark, sf_dir):
    spec = samples.minimal(added_tokens=[{"id": 1, "content": "the", "normalized": True}], normalizer={"type": "Replace", "pattern": {"String": "t"}, "content": "x"})
    return docs(spark, sf_dir).select("doc_id", F.size(F.filter(arrow.segments(F.col("text"), spec), lambda s: s["token_id"] == 1)).cast("long").alias("n"))


@query("SELECT source, CAST(count(*) AS BIGINT) AS n FROM documents WHERE contains(text, 'ing') OR contains(text, 'then') GROUP BY source")
def added_token_candidates(spark, sf_dir):
    return docs(spark, sf_dir).where(F.contains("text", F.lit("ing")) | F.contains("text", F.lit("then"))).groupBy("source").agg(F.count("*").alias("n"))


# BPE

HEX = lambda raw: raw.encode("latin-1").hex().upper()
MERGES = [(HEX(a), HEX(b)) for a, b in samples.byte_merges()]


def sql_tokens(piece: str) -> str:
    """Tokens, in hex, of a piece by one replacement for each merge."""
    out = f"regexp_replace(hex(encode({piece})), '(..)', chr(2) || '\\1' || chr(3), 'g')"
    for a, b in MERGES:
        out = f"replace({out}, chr(2) || '{a}' || chr(3) || chr(2) || '{b}' || chr(3), chr(2) || '{a}{b}' || chr(3))"
    return f"list_filter(string_split(replace({out}, chr(2), ''), chr(3)), lambda x: x <> '')"


ID = f"CASE WHEN length(t) = 2 THEN CAST('0x' || t AS INTEGER) ELSE 255 + list_position([{', '.join(q(a + b) for a, b in MERGES)}], t) END"
TOKENS = f"flatten(list_transform({GPT2}, lambda p: {sql_tokens('p')}))"
IDS = f"list_transform({TOKENS}, lambda t: {ID})"
N = len(MERGES) + 256
BOS_ID, EOS_ID, PAD_ID = N, N + 1, N + 2
ENCODED = f"(SELECT doc_id, source, text, {IDS} AS ids FROM documents)"


def bpe(**options) -> Engine:
    return Engine(samples.byte_bpe(**options))


@query(sql_digest(TOKENS))
def bpe_tokens_catalyst(spark, sf_dir):
    return digest(docs(spark, sf_dir), C.bpe_fold_pieces(C.grammar(F.col("text"), "gpt2"), MERGES))


query(sql_digest(IDS, sep=" "), "bpe_encode")(lambda spark, d: digest(docs(spark, d), bpe().ids(F.col("text")), sep=" "))
query(sql_digest(IDS, sep=" "), "bpe_encode_pieces")(lambda spark, d: digest(docs(spark, d), arrow.pieces_ids(C.grammar(F.col("text"), "gpt2"), samples.byte_bpe()), sep=" "))


@query(f"SELECT source, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(ids)) AS BIGINT) AS n_tokens, CAST(max(len(ids)) AS BIGINT) AS longest FROM {ENCODED} GROUP BY source")
def bpe_token_counts(spark, sf_dir):
    own = docs(spark, sf_dir).select("source", F.size(bpe().ids(F.col("text"))).cast("long").alias("n"))
    return own.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"), F.max("n").alias("longest"))


WHOLE = [HEX(a + b) for a, b in samples.byte_merges()]
query(sql_digest(f"flatten(list_transform({GPT2}, lambda p: CASE WHEN list_contains([{', '.join(map(q, WHOLE))}], hex(encode(p))) THEN [hex(encode(p))] ELSE {sql_tokens('p')} END))"), "bpe_ignore_merges")(
    lambda spark, d: digest(docs(spark, d), F.transform(bpe(ignore_merges=True).ids(F.col("text")), _hex_of))
)


def _hex_of(i: Column) -> Column:
    return F.when(i < 256, F.lpad(F.hex(i), 2, "0")).otherwise(F.get(F.array(*[F.lit(x) for x in WHOLE]), i - 256))


def _sql_char_tokens() -> str:
    out = "regexp_replace(replace(text, ' ', '▁'), '([a-z▁])', chr(2) || '\\1' || chr(3), 'g')"
    for x in samples.PAIRS:
        out = f"replace({out}, chr(2) || '{x[0]}' || chr(3) || chr(2) || '{x[1]}' || chr(3), chr(2) || '{x}' || chr(3))"
    return out


@query(f"SELECT doc_id, CAST(length(t) - length(replace(t, chr(2), '')) + strlen(regexp_replace(t, chr(2) || '[^' || chr(3) || ']*' || chr(3), '', 'g')) AS BIGINT) AS n FROM (SELECT doc_id, {_sql_char_tokens()} AS t FROM documents)")
def bpe_byte_fallback(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.size(Engine(samples.char_bpe()).ids(F.col("text"))).cast("long").alias("n"))


@query()
def public_bpe_encode(spark, sf_dir):
    """A public byte-level tokenizer of 50,257 tokens; tests compare it with its own library."""
    import public_tokenizers

    return digest(docs(spark, sf_dir), Engine.from_file(public_tokenizers.path("byte_bpe_50k.json")).ids(F.col("text"), False), sep=" ")


# Unigram


def _sql_unigram() -> str:
    vocab = [x for x in enumerate(samples.unigram_vocab()) if x[0]]
    rows = ", ".join(f"({q(p)}, {i}, CAST({s} AS DOUBLE))" for i, (p, s) in vocab)
    unknown = min(s for _, s in samples.unigram_vocab()) - 10
    size = max(len(p) for _, (p, _) in vocab)
    none = "CAST(-1e300 AS DOUBLE)"
    cand = [f"CASE WHEN n >= {k - 1} THEN sc[n - {k - 2}] + v{k}.s END" for k in range(1, size + 1)]
    cand[0] = f"sc[n + 1] + coalesce(v1.s, {unknown})"
    joins = " ".join(f"LEFT JOIN v AS v{k} ON n >= {k - 1} AND v{k}.p = substr(w, n - {k - 2}, {k})" for k in range(1, size + 1))
    best = "greatest(" + ", ".join(f"coalesce({c}, {none})" for c in cand) + ")"
    chosen = " ".join(f"WHEN {cand[k - 1]} = {best} THEN path[n - {k - 2}] || coalesce(v{k}.i, -1) || ','" for k in range(size, 0, -1))
    return f"""WITH RECURSIVE v(p, i, s) AS (VALUES {rows}),
    words AS (SELECT doc_id, pos, '▁' || w AS w FROM (SELECT doc_id, unnest(l) AS w, unnest(range(1, len(l) + 1)) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '\\S+') AS l FROM documents))),
    r AS (SELECT w, 0 AS n, [CAST(0 AS DOUBLE)] AS sc, [''] AS path FROM (SELECT DISTINCT w FROM words)
      UNION ALL SELECT w, n + 1, list_append(sc, {best}), list_append(path, CASE {chosen} END) FROM r {joins} WHERE n < length(w)),
    done AS (SELECT w, string_split(rtrim(regexp_replace(path[n + 1], '(-1,)+', '0,', 'g'), ','), ',') AS ids FROM r WHERE n = length(w))
    SELECT doc_id, CAST(coalesce(sum(len(ids)), 0) AS BIGINT) AS n, md5(coalesce(string_agg(array_to_string(ids, ' '), ' ' ORDER BY pos), '')) AS digest FROM documents LEFT JOIN (words JOIN done USING (w)) USING (doc_id) GROUP BY doc_id"""


@query(_sql_unigram())
def unigram_encode(spark, sf_dir):
    return digest(docs(spark, sf_dir), Engine(samples.unigram()).ids(F.col("text")), sep=" ")


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '[^a-z\\s]+')) AS BIGINT) AS n FROM documents")
def unigram_unknown_runs(spark, sf_dir):
    """Runs of characters that no piece spells are one unknown token each."""
    ids = Engine(samples.unigram()).ids(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.size(F.filter(ids, lambda i: i == 0)).cast("long").alias("n"))


# templates, limits, padding

query(sql_digest(f"list_concat([{BOS_ID}], ids, [{EOS_ID}])", ENCODED, sep=" "), "template_bos_eos")(lambda spark, d: digest(docs(spark, d), bpe(template=True).ids(F.col("text")), sep=" "))
query(sql_digest("ids", ENCODED, sep=" "), "template_without_specials")(lambda spark, d: digest(docs(spark, d), bpe(template=True).ids(F.col("text"), False), sep=" "))
query("SELECT CAST(2 AS BIGINT) AS n", "num_special_tokens")(lambda spark, d: spark.range(1).select(F.lit(bpe(template=True).tokenizer.num_special_tokens_to_add()).cast("long").alias("n")))


def _limit_query(direction: str, most: int) -> None:
    kept = f"ids[1:{most}]" if direction == "right" else f"ids[greatest(len(ids) - {most - 1}, 1):]"
    sql = f"SELECT doc_id, CAST(len({kept}) AS BIGINT) AS n, md5(array_to_string({kept}, ' ')) AS digest, len(ids) > {most} AS truncated FROM {ENCODED}"

    def limited(spark, d):
        own = docs(spark, d).select("doc_id", bpe().with_limit(F.col("text"), most, direction).alias("e"))
        return own.select("doc_id", F.size("e.ids").cast("long").alias("n"), F.md5(F.array_join("e.ids", " ").cast("binary")).alias("digest"), "e.truncated")

    query(sql, f"limit_{direction}")(limited)
    room = most - 2
    kept = kept.replace(f":{most}]", f":{room}]").replace(f"- {most - 1}", f"- {room - 1}")
    sql = f"SELECT doc_id, CAST(len(x) AS BIGINT) AS n, md5(array_to_string(x, ' ')) AS digest, truncated FROM (SELECT doc_id, list_concat([{BOS_ID}], {kept}, [{EOS_ID}]) AS x, len(ids) > {room} AS truncated FROM {ENCODED})"

    def truncated(spark, d):
        own = docs(spark, d).select("doc_id", bpe(template=True).with_truncation(most, direction=direction).encode(F.col("text")).alias("e"))
        return own.select("doc_id", F.size("e.ids").cast("long").alias("n"), F.md5(F.array_join("e.ids", " ").cast("binary")).alias("digest"), "e.truncated")

    query(sql, f"truncate_{direction}")(truncated)


_limit_query("right", 64)
_limit_query("left", 64)

PADDED = "SELECT doc_id, CAST(target AS BIGINT) AS n, md5({x}) AS digest, CAST(len(ids) AS BIGINT) AS attended FROM (SELECT *, {t} AS target FROM {e})"
_RIGHT = f"ltrim(array_to_string(ids, ' ') || repeat(' {PAD_ID}', CAST(target - len(ids) AS BIGINT)))"


def _attended() -> Column:
    """How many ids of an encoding are attended to, counted in the padded mask."""
    return F.size(F.array_remove("encoding.attention_mask", 0)).cast("long")


def _padded(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.size("encoding.ids").cast("long").alias("n"), F.md5(F.array_join("encoding.ids", " ").cast("binary")).alias("digest"), _attended().alias("attended"))


query(PADDED.format(x=_RIGHT, t="greatest(256, len(ids))", e=ENCODED), "pad_fixed")(lambda spark, d: _padded(bpe(specials=True).with_padding(length=256, pad_id=PAD_ID).encode_batch(docs(spark, d))))
query(PADDED.format(x=_RIGHT, t="CAST(ceil(len(ids) / 64.0) AS BIGINT) * 64", e=ENCODED), "pad_to_multiple")(lambda spark, d: _padded(bpe(specials=True).with_padding(pad_id=PAD_ID, pad_to_multiple_of=64).encode_batch(docs(spark, d))))
query(
    f"SELECT doc_id, CAST(target AS BIGINT) AS n, CAST(len(ids) AS BIGINT) AS attended, CAST(CASE WHEN target > len(ids) THEN {PAD_ID} ELSE ids[1] END AS BIGINT) AS first FROM (SELECT *, max(len(ids)) OVER (PARTITION BY source) AS target FROM {ENCODED})", "pad_batch_longest"
)(lambda spark, d: _padded_left(spark, d))


def _padded_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source is a batch; 512 ids at most are kept of none: rows are as long as the longest."""
    got = bpe(specials=True).with_padding(pad_id=PAD_ID, direction="left").encode_batch(docs(spark, sf_dir), batch_col="source")
    return got.select("doc_id", F.size("encoding.ids").cast("long").alias("n"), _attended().alias("attended"), F.get("encoding.ids", F.lit(0)).cast("long").alias("first"))


@query(f"SELECT conv_id, CAST(sum(len(ids)) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS n_sequences, md5(coalesce(string_agg(array_to_string(ids, ' '), ' ' ORDER BY turn) FILTER (WHERE len(ids) > 0), '')) AS digest FROM (SELECT conv_id, turn, {IDS} AS ids FROM conversations) GROUP BY conv_id")
def encoding_merge(spark, sf_dir):
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", bpe().ids(F.col("text")).alias("ids"))
    return relational.merged(own, "conv_id", "turn").select("conv_id", F.size("ids").cast("long").alias("n"), "n_sequences", F.md5(F.array_join("ids", " ").cast("binary")).alias("digest"))


# ragged and flat batches

query(f"SELECT doc_id, CAST(e - n AS BIGINT) AS start, CAST(e AS BIGINT) AS \"end\" FROM (SELECT doc_id, len(ids) AS n, sum(len(ids)) OVER (ORDER BY doc_id) AS e FROM {ENCODED})", "flat_offsets")(lambda spark, d: bpe().flat(docs(spark, d), "doc_id").select("doc_id", "start", "end"))


@query(f"SELECT token_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(pos) AS BIGINT) AS pos_sum FROM (SELECT unnest(ids) AS token_id, unnest(range(len(ids))) AS pos FROM {ENCODED}) GROUP BY token_id")
def ragged_rows(spark, sf_dir):
    return bpe().ragged(docs(spark, sf_dir), "doc_id").groupBy("token_id").agg(F.count("*").alias("n"), F.sum(F.col("pos").cast("long")).alias("pos_sum"))


# decoding

query("SELECT doc_id, md5(text) AS digest FROM documents", "decode_roundtrip")(lambda spark, d: _md5(spark, d, bpe().decode(bpe().ids(F.col("text")))))
query("SELECT doc_id, md5(text) AS digest FROM documents", "decode_skip_special")(lambda spark, d: _md5(spark, d, bpe(template=True).decode(bpe(template=True).ids(F.col("text")), True)))
query(f"SELECT doc_id, md5('{samples.BOS}' || text || '{samples.EOS}') AS digest FROM documents", "decode_with_specials")(lambda spark, d: _md5(spark, d, bpe(template=True).decode(bpe(template=True).ids(F.col("text")))))
query("SELECT doc_id, md5(text) AS digest FROM documents", "decode_unknown_ids")(lambda spark, d: _md5(spark, d, bpe().decode(F.concat(F.array(F.lit(4294967295)), bpe().ids(F.col("text")).cast("array<bigint>"), F.array(F.lit(70000).cast("bigint"))))))
query("SELECT doc_id, md5(text) AS digest FROM documents", "decode_byte_fallback")(lambda spark, d: _md5(spark, d, Engine(samples.char_bpe()).decode(Engine(samples.char_bpe()).ids(F.col("text")))))
query("SELECT doc_id, md5(replace(replace(text, ' ', '_'), '_', ' ')) AS digest FROM documents", "decode_tokens_replace")(lambda spark, d: _md5(spark, d, Engine(samples.minimal(decoder={"type": "Replace", "pattern": {"String": "_"}, "content": " "})).decode_tokens(C.whitespace_free(F.replace(F.col("text"), F.lit(" "), F.lit("_"))))))


@query("SELECT i AS id, CASE WHEN i < 256 THEN NULL WHEN i = " + str(BOS_ID) + " THEN '" + samples.BOS + "' WHEN i = " + str(EOS_ID) + " THEN '" + samples.EOS + "' ELSE '" + samples.PAD + "' END AS token, true AS special FROM (SELECT unnest([" + f"{BOS_ID}, {EOS_ID}, {PAD_ID}" + "]) AS i)")
def added_tokens_decoder(spark, sf_dir):
    return bpe(specials=True).added_tokens(spark).select("id", F.col("content").alias("token"), "special")


@query(f"SELECT CAST({N} AS BIGINT) AS model, CAST({N + 3} AS BIGINT) AS whole, CAST({N + 3} AS BIGINT) AS distinct_spellings")
def vocab_sizes(spark, sf_dir):
    e = bpe(specials=True)
    model, added = e.vocab(spark, False), e.added_tokens(spark).select(F.col("content").alias("token"), "id")
    union = model.unionByName(added).dropDuplicates(["token"])
    return model.agg(F.count("*").alias("model")).crossJoin(spark.range(1).select(F.lit(e.tokenizer.vocab_size).cast("long").alias("whole"))).crossJoin(union.agg(F.count("*").alias("distinct_spellings")))


@query(f"SELECT token_id AS id, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(ids) AS token_id FROM {ENCODED}) WHERE token_id >= 256 GROUP BY token_id")
def vocabulary_join(spark, sf_dir):
    """Counts of the merged tokens, by an equi-join with the vocabulary table."""
    e = bpe()
    rows = e.ragged(docs(spark, sf_dir), "doc_id").groupBy("token_id").agg(F.count("*").alias("n"))
    return rows.join(e.vocab(spark).where("id >= 256"), F.col("token_id") == F.col("id")).select("id", "n")


# streams

_DECODED = f"SELECT conv_id, md5(string_agg(text, '' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id"


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(bpe().ids(F.col("text"))).alias("pos", "token_id"))
    return rows.select(F.col("conv_id").alias("stream_id"), (F.col("turn") * F.lit(1 << 32) + F.col("pos")).alias("seq"), "token_id")


def _joined(emitted: DataFrame) -> DataFrame:
    said = emitted.where("emitted is not null").groupBy("stream_id").agg(F.sort_array(F.collect_list(F.struct("seq", "emitted"))).alias("said"))
    return said.select(F.col("stream_id").cast("long").alias("conv_id"), F.md5(F.array_join("said.emitted", "").cast("binary")).alias("digest"))


query(_DECODED, "stream_decode_replay")(lambda spark, d: _joined(replay(_steps(spark, d), samples.byte_bpe())))


@query(_DECODED)
def stream_decode_live(spark, sf_dir):
    """The steps as a file stream, decoded with state in the state store, until all are taken."""
    top = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    steps = _steps(spark, sf_dir)
    steps.write.parquet(f"{top}/in")
    live = decode_stream(corpus.stream(spark, f"{top}/in", steps.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")), samples.byte_bpe())
    run = live.writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return _joined(spark.read.parquet(f"{top}/out"))


# around tokenization

query("SELECT char, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(regexp_extract_all(text, '(?s).')) AS char FROM documents) WHERE NOT regexp_matches(char, '^[a-z ]$') GROUP BY char", "oov_chars_anti_join")(lambda spark, d: relational.unknown_characters(docs(spark, d), Engine(samples.char_bpe()).vocab(spark).withColumn("token", F.replace("token", F.lit("▁"), F.lit(" ")))))
query(f"SELECT source, lang, CAST(grouping(source) * 2 + grouping(lang) AS BIGINT) AS level, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(ids)) AS BIGINT) AS n_tokens FROM (SELECT source, lang, {IDS} AS ids FROM documents) GROUP BY CUBE (source, lang)", "token_stats_cube")(lambda spark, d: relational.stats_cube(docs(spark, d).withColumn("n", F.size(bpe().ids(F.col("text"))).cast("long"))))
query(f"SELECT source, token_id, n, CAST(rank AS BIGINT) AS rank FROM (SELECT source, token_id, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, token_id) AS rank FROM (SELECT source, token_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT source, unnest(ids) AS token_id FROM {ENCODED}) GROUP BY source, token_id)) WHERE rank <= 10", "token_rank_window")(lambda spark, d: relational.ranked(bpe().ragged(docs(spark, d).withColumn("key", F.struct("doc_id", "source")), "key").select("key.source", "token_id"), 10))
query(f"SELECT doc_id, CAST((e - n) // 2048 AS BIGINT) AS first_context, CAST((e - 1) // 2048 AS BIGINT) AS last_context, CAST((e - n) % 2048 AS BIGINT) AS place FROM (SELECT doc_id, len(ids) AS n, sum(len(ids)) OVER (ORDER BY doc_id) AS e FROM {ENCODED}) WHERE n > 0", "context_packing")(lambda spark, d: relational.packed(bpe().flat(docs(spark, d), "doc_id"), 2048))
query(
    "WITH g AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS gram FROM (SELECT item_id, regexp_extract_all(text, '\\S+') AS w FROM benchmark)), d AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS gram FROM (SELECT doc_id, regexp_extract_all(text, '\\S+') AS w FROM documents)) SELECT doc_id, item_id, CAST(count(DISTINCT gram) AS BIGINT) AS shared FROM d JOIN g USING (gram) GROUP BY doc_id, item_id",
    "contamination_join",
)(lambda spark, d: relational.shared_grams(docs(spark, d), table(spark, d, "benchmark"), 8))
query("SELECT conv_id, md5(string_agg('[' || role || ']: ' || text, chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id", "rendered_chats")(lambda spark, d: corpus.rendered(table(spark, d, "conversations")).select("conv_id", F.md5(F.col("text").cast("binary")).alias("digest")))


@query(f"SELECT CAST({N} AS BIGINT) AS vocabulary, CAST({len(MERGES)} AS BIGINT) AS merges, CAST(2 * {N} AS BIGINT) AS ids")
def snapshot_roundtrip(spark, sf_dir):
    """A specification as Parquet and back: the tables that a snapshot holds."""
    import tempfile

    from ..sources import snapshot

    with tempfile.TemporaryDirectory() as top:  # read again by this process only
        snapshot.save(samples.byte_bpe(), f"{top}/s.tfs")
        e = Engine(snapshot.load(f"{top}/s.tfs"))
    both = e.vocab(spark).join(bpe().vocab(spark), ["token", "id"])
    return both.agg(F.count("*").alias("vocabulary"), F.lit(len(e.spec.model.merges)).cast("long").alias("merges"), (F.count("*") * 2).alias("ids"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '[^a]') THEN 'rejected' END AS error, CAST(CASE WHEN NOT regexp_matches(text, '[^a]') THEN length(text) END AS BIGINT) AS n FROM documents")
def permissive_errors(spark, sf_dir):
    """A model of one letter rejects nearly all texts; the query goes on."""
    own = docs(spark, sf_dir).select("doc_id", Engine(samples.minimal()).checked_ids(F.col("text")).alias("e"))
    return own.select("doc_id", F.when(F.col("e.error").isNotNull(), "rejected").alias("error"), F.size("e.ids").cast("long").alias("n"))


@query(f"SELECT doc_id, CAST(len(ids) AS BIGINT) AS n FROM {ENCODED}")
def sql_functions(spark, sf_dir):
    bpe().register(spark, "sample")
    docs(spark, sf_dir).createOrReplaceTempView("sample_documents")
    return spark.sql("SELECT doc_id, CAST(size(sample_encode(text)) AS BIGINT) AS n FROM sample_documents")


@query(f"SELECT doc_id, CAST(len(ids) AS BIGINT) AS n, CAST(coalesce(list_sum(list_transform(ids, lambda x: CAST(x AS BIGINT))), 0) AS BIGINT) AS id_sum FROM {ENCODED} WHERE len(ids) > 0")
def sql_table_function(spark, sf_dir):
    bpe().register(spark, "sample")
    docs(spark, sf_dir).createOrReplaceTempView("sample_documents")
    return spark.sql("SELECT doc_id, count(*) AS n, sum(token_id) AS id_sum FROM sample_documents, LATERAL sample_tokens(text) GROUP BY doc_id")


def explain() -> str:
    """The stages of the sample tokenizers and the engine that each runs on."""
    return json.dumps({name: Engine(spec).plan() for name, spec in (("byte_bpe", samples.byte_bpe()), ("char_bpe", samples.char_bpe()), ("unigram", samples.unigram()))}, indent=1)


from . import edge_queries  # noqa: E402, F401  registers more
