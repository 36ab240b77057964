"""Queries of the rules at the edges of the models, of encodings, and of relational work around them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import arrow
from ..sources import corpus, samples
from ..sources.spec import TokenizerSpec
from ..streaming.decode import replay
from .engine import Engine
from .queries import ADDED, BOS_ID, ENCODED, EOS_ID, GPT2, IDS, MERGES, N, bpe, digest, docs, q, query, sql_digest, table
from .storage import shared_folder

LETTERS = [chr(c) for c in range(ord("a"), ord("z") + 1)]
BYTES = [f"<0x{b:02X}>" for b in range(256)]


def _bpe(vocab: list[str], merges: list[list[str]], **parts) -> Engine:
    model = {"type": "BPE", "vocab": {t: i for i, t in enumerate(vocab)}, "merges": merges, "byte_fallback": parts.pop("byte_fallback", False)}
    return Engine(TokenizerSpec.from_dict({"model": model, **parts}))


def _unigram(vocab: list[str], **parts) -> Engine:
    model = {"type": "Unigram", "vocab": [[t, -1.0 - i / 512] for i, t in enumerate(vocab)], "unk_id": 0, "byte_fallback": parts.pop("byte_fallback", False)}
    return Engine(TokenizerSpec.from_dict({"model": model, **parts}))


# models

WHOLE = ("the", "and", "of")
_whole_words = "regexp_extract_all(text, '\\b(?:the|and|of)\\b')"


@query(sql_digest(f"list_transform({_whole_words}, lambda w: CASE w WHEN 'the' THEN 0 WHEN 'and' THEN 1 ELSE 2 END)", sep=" "))
def bpe_whole_pieces(spark, sf_dir):
    """Tokens that no merge makes: a piece that is one is found as a whole."""
    own = docs(spark, sf_dir).withColumn("text", F.array_join(F.regexp_extract_all("text", F.lit(r"\b(?:the|and|of)\b"), F.lit(0)), " "))
    return digest(own, _bpe(list(WHOLE), [], pre_tokenizer={"type": "WhitespaceSplit"}).ids(F.col("text")), sep=" ")


_pairs = "regexp_replace(hex(encode({x})), '(..)', '\\1 ', 'g')"
_joined = f"replace({_pairs.format(x='text')}, 'A9 C3 ', 'A9C3 ')"


@query(sql_digest(f"list_transform(list_filter(string_split({_joined}, ' '), lambda t: t <> ''), lambda t: CASE WHEN t = 'A9C3' THEN 256 ELSE CAST('0x' || t AS INTEGER) END)", sep=" "))
def bpe_fallback_merges_across_characters(spark, sf_dir):
    """Byte tokens merge over the end of a character: of é and the one after it."""
    e = _bpe([*BYTES, "<0xA9><0xC3>"], [["<0xA9>", "<0xC3>"]], byte_fallback=True)
    return digest(docs(spark, sf_dir), e.ids(F.col("text")), sep=" ")


_spelled = f"list_transform(list_filter(string_split({_pairs.format(x='w')}, ' '), lambda t: t <> ''), lambda t: CASE WHEN t BETWEEN '61' AND '7A' AND length(t) = 2 THEN CAST('0x' || t AS INTEGER) - 96 ELSE 27 + CAST('0x' || t AS INTEGER) END)"


@query(sql_digest(f"flatten(list_transform(regexp_extract_all(text, '\\S+'), lambda w: {_spelled}))", sep=" "))
def unigram_byte_fallback(spark, sf_dir):
    """What no piece spells comes out as its bytes."""
    e = _unigram(["<unk>", *LETTERS, *BYTES], byte_fallback=True, pre_tokenizer={"type": "WhitespaceSplit"})
    return digest(docs(spark, sf_dir), e.ids(F.col("text")), sep=" ")


@query(sql_digest("list_transform(regexp_extract_all(regexp_replace(text, '[^a-z]', '', 'g'), '.'), lambda c: ascii(c) - 97 + 27)", sep=" "))
def unigram_duplicate_pieces(spark, sf_dir):
    """Every letter stands twice in the vocabulary; the later one counts, though its score is less."""
    own = docs(spark, sf_dir).withColumn("text", F.regexp_replace("text", "[^a-z]", ""))
    return digest(own, _unigram(["<unk>", *LETTERS, *LETTERS]).ids(F.col("text")), sep=" ")


@query("SELECT doc_id, CAST(CASE WHEN text = '' THEN 0 ELSE 1 END AS BIGINT) AS n FROM documents")
def unigram_empty_vocabulary(spark, sf_dir):
    """Without any piece a whole text is one unknown token."""
    return docs(spark, sf_dir).select("doc_id", F.size(_unigram([""]).ids(F.col("text"))).cast("long").alias("n"))


@query(f"WITH t(token) AS (SELECT unnest([{', '.join(q(t) for t in [*LETTERS, '▁', *BYTES, *samples.PAIRS])}])), h AS (SELECT hex(encode(token)) AS h FROM t), b AS (SELECT DISTINCT substr(h, 2 * i - 1, 2) AS x, substr(h, 2 * i + 1, 2) AS y FROM (SELECT h, unnest(range(1, length(h) // 2)) AS i FROM h)) SELECT CAST('0x' || x AS INTEGER) AS before, CAST('0x' || y AS INTEGER) AS after FROM b")
def bridge_pairs(spark, sf_dir):
    """All pairs of bytes that some token has side by side."""
    return Engine(samples.char_bpe()).bridges(spark)


@query(f"WITH p AS (SELECT unnest(list_zip(ids[1:len(ids) - 1], ids[2:])) AS p FROM {ENCODED}) SELECT p[1] AS a, p[2] AS b, CAST(count(*) AS BIGINT) AS n, true AS can FROM p WHERE p[2] IS NOT NULL GROUP BY ALL")
def compatible_pairs(spark, sf_dir):
    """How often each pair of adjacent ids occurs in the encoded corpus, and whether it can: a pair inside a
    piece, and a pair of different pieces, for which the pieces are put together, may differ, so only
    pairs within pieces are asked for; across pieces it is always allowed."""
    ids = docs(spark, sf_dir).select(bpe().ids(F.col("text")).alias("ids"))
    pairs = ids.select(F.explode(F.arrays_zip(F.slice("ids", F.lit(1), F.greatest(F.size("ids") - 1, F.lit(0))).alias("a"), F.slice("ids", F.lit(2), F.size("ids")).alias("b"))).alias("p"))
    counted = pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("n"))
    return counted.withColumn("can", arrow.compatible(F.col("a"), F.col("b"), samples.byte_bpe()))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '[^a]') THEN 'rejected' END AS error FROM documents")
def validate_input(spark, sf_dir):
    """What the model would reject, without encoding."""
    return docs(spark, sf_dir).select("doc_id", F.when(Engine(samples.minimal()).rejected(F.col("text")).isNotNull(), "rejected").alias("error"))


# stages


@query("SELECT doc_id, md5(CASE WHEN t = '' THEN '' ELSE '-' || array_to_string(list_transform(regexp_extract_all(t, '(?s).'), lambda c: c || '-'), '') END) AS digest FROM (SELECT doc_id, CASE WHEN contains(text, 'ing') THEN '' ELSE text END AS t FROM documents)")
def empty_input_bypass(spark, sf_dir):
    """A normalizer that would put text into an empty one never sees it."""
    own = docs(spark, sf_dir).withColumn("text", F.when(F.contains("text", F.lit("ing")), "").otherwise(F.col("text")))
    e = Engine(samples.minimal(normalizer={"type": "Replace", "pattern": {"String": ""}, "content": "-"}))
    return own.select("doc_id", F.md5(e.normalized(F.col("text")).cast("binary")).alias("digest"))


@query("SELECT source, CAST(count(*) AS BIGINT) AS n FROM documents WHERE " + " OR ".join(f"contains(text, '{t}')" for t in ADDED) + " GROUP BY source")
def added_token_prefilter(spark, sf_dir):
    """Texts without any added token needn't be segmented."""
    e = Engine(samples.minimal(added_tokens=[{"id": i, "content": t} for t, i in ADDED.items()]))
    return docs(spark, sf_dir).where(e.has_candidate(F.col("text"))).groupBy("source").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, CAST(len(x) AS BIGINT) AS n, md5(array_to_string(x, ' ')) AS digest, truncated FROM (SELECT doc_id, list_concat([{BOS_ID}], ids[1:50], [{EOS_ID}]) AS x, len(ids) > 50 AS truncated FROM {ENCODED})")
def post_process_encodings(spark, sf_dir):
    """The template around encodings that are already truncated; they stay marked so."""
    e = bpe(template=True)
    own = docs(spark, sf_dir).select("doc_id", e.post_process_encoding(e.with_truncation(50).encode(F.col("text"), False)).alias("e"))
    return own.select("doc_id", F.size("e.ids").cast("long").alias("n"), F.md5(F.array_join("e.ids", " ").cast("binary")).alias("digest"), "e.truncated")


@query("SELECT doc_id, CAST(2 AS BIGINT) AS special, CAST(2 AS BIGINT) AS known FROM documents")
def special_token_ids(spark, sf_dir):
    """Ids of special tokens in each encoding: the template puts two around it."""
    e = bpe(template=True)
    own = docs(spark, sf_dir).select("doc_id", e.ids(F.col("text")).alias("ids"))
    return own.select("doc_id", F.size(F.filter("ids", e.is_special)).cast("long").alias("special"), F.size(F.filter("ids", lambda i: i >= N)).cast("long").alias("known"))


@query(f"SELECT token, id FROM (SELECT unnest([{', '.join(f'{{token: {q(a + b)}, id: {256 + r}}}' for r, (a, b) in enumerate(MERGES))}], recursive := true))")
def vocabulary_file(spark, sf_dir):
    """vocab.json, written and read again: the merged tokens, by the bytes that they spell."""
    from .queries import _unspelled

    e, folder = bpe(), f"{shared_folder(spark)}/vocabulary-{uuid.uuid4().hex}"
    e.save_vocabulary(spark, folder)
    rows = spark.read.text(f"{folder}/vocab.json", wholetext=True).select(F.explode(F.from_json("value", "map<string,int>")).alias("token", "id"))
    return rows.where("id >= 256").select(_unspelled(F.col("token")).alias("token"), "id")


# streams


_DECODED = "SELECT conv_id, md5(string_agg(text, '' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id"


def _steps_of_three(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", bpe().ids(F.col("text")).alias("ids"))
    cut = F.when(F.size("ids") > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size("ids") - 1) / 3)), lambda i: F.slice("ids", (i * 3 + 1).cast("int"), F.lit(3))))
    rows = rows.select("conv_id", "turn", F.posexplode(cut).alias("pos", "token_id"))
    return rows.select(F.col("conv_id").alias("stream_id"), (F.col("turn") * F.lit(1 << 32) + F.col("pos")).alias("seq"), "token_id")


def _said(emitted):
    said = emitted.where("emitted is not null").groupBy("stream_id").agg(F.sort_array(F.collect_list(F.struct("seq", "emitted"))).alias("said"))
    return said.select(F.col("stream_id").alias("conv_id"), F.md5(F.array_join("said.emitted", "").cast("binary")).alias("digest"))


@query(_DECODED)
def stream_decode_lists(spark, sf_dir):
    """Three ids a step."""
    return _said(replay(_steps_of_three(spark, sf_dir), samples.byte_bpe()))


@query(_DECODED)
def stream_decode_seeded(spark, sf_dir):
    """Behind a context, whose text isn't given out."""
    return _said(replay(_steps_of_three(spark, sf_dir), samples.byte_bpe(), context=bpe().tokenizer.ids("the context, é")))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def stream_window_counts(spark, sf_dir):
    """Events by hour over a stream, with a watermark of a day for late ones; each micro-batch's windows take the
    place of those before."""
    top = f"{shared_folder(spark)}/windows-{uuid.uuid4().hex}"
    table(spark, sf_dir, "events").select("event_id", "ts", "event_type").repartitionByRange(4, "event_id").write.parquet(f"{top}/in")
    live = corpus.stream(spark, f"{top}/in", "event_id long, ts timestamp, event_type string", 1).withWatermark("ts", "1 day")
    counts = live.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))

    def keep(batch, number: int) -> None:
        batch.select(F.col("window.start").alias("hour"), "event_type", "n").write.mode("overwrite").parquet(f"{top}/out")

    run = counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{top}/out")


# relational work


def _pieces_of(spark, sf_dir, lang: str):
    return docs(spark, sf_dir).where(F.col("lang") == lang).select(F.explode(C.grammar(F.col("text"), "gpt2")).alias("piece"))


_of = "SELECT unnest({g}) AS piece FROM documents WHERE lang = '{lang}'"
query(f"({_of.format(g=GPT2, lang='en')}) INTERSECT ({_of.format(g=GPT2, lang='fr')})", "shared_pieces")(lambda spark, d: _pieces_of(spark, d, "en").intersect(_pieces_of(spark, d, "fr")))
query(f"SELECT piece, CAST(count(*) AS BIGINT) AS n FROM (({_of.format(g=GPT2, lang='es')}) EXCEPT ALL ({_of.format(g=GPT2, lang='de')})) GROUP BY piece", "surplus_pieces")(
    lambda spark, d: _pieces_of(spark, d, "es").exceptAll(_pieces_of(spark, d, "de")).groupBy("piece").agg(F.count("*").alias("n"))
)


@query(f"SELECT lang, CAST(count(DISTINCT piece) AS BIGINT) AS n, true AS near FROM (SELECT lang, unnest({GPT2}) AS piece FROM documents) GROUP BY lang")
def approx_distinct_pieces(spark, sf_dir):
    """A sketch of the number of distinct pieces, and whether it is within a twentieth of it."""
    own = docs(spark, sf_dir).select("lang", F.explode(C.grammar(F.col("text"), "gpt2")).alias("piece")).groupBy("lang", "piece").agg(F.lit(1).alias("one"))
    own = own.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("piece", 0.01).alias("about"))
    return own.select("lang", "n", (20 * F.abs(F.col("about") - F.col("n")) <= F.greatest(F.col("n"), F.lit(20))).alias("near"))


@query(f"SELECT CAST(floor(sqrt(len(ids))) AS BIGINT) AS root, CAST(count(*) AS BIGINT) AS n, CAST(max(len(ids) % 7) AS BIGINT) AS rest FROM {ENCODED} GROUP BY root")
def length_histogram(spark, sf_dir):
    """Documents by the whole root of their number of tokens."""
    own = docs(spark, sf_dir).select(F.size(bpe().ids(F.col("text"))).cast("long").alias("k"))
    return own.groupBy(F.floor(F.sqrt("k")).alias("root")).agg(F.count("*").alias("n"), F.max(F.col("k") % 7).alias("rest"))


@query(f"SELECT date_trunc('day', ts) AS day, CAST(dayofweek(ts) + 1 AS INTEGER) AS weekday, CAST(count(*) AS BIGINT) AS n, CAST(sum(len(ids)) AS BIGINT) AS n_tokens FROM (SELECT ts, {IDS.replace('(text', '(props')} AS ids FROM events) GROUP BY ALL")
def tokens_by_day(spark, sf_dir):
    """Tokens of the events' properties by day."""
    own = table(spark, sf_dir, "events").select(F.date_trunc("day", "ts").alias("day"), F.dayofweek("ts").alias("weekday"), F.size(bpe().ids(F.col("props"))).cast("long").alias("k"))
    return own.groupBy("day", "weekday").agg(F.count("*").alias("n"), F.sum("k").alias("n_tokens"))
