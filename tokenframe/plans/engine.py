"""Compilation of a tokenizer specification into columns and DataFrames.

For each stage the planner takes built-in expressions where they say exactly what the stage means,
and an Arrow UDF elsewhere; `Engine.plan()` tells which. Only texts and id lists pass to a worker.
"""

from __future__ import annotations

import json
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import UnsupportedError
from ..functions import columns as C
from ..functions.grammars import name_of
from ..functions.normalizers import pattern_of
from ..functions.pretokenizers import metaspace_options
from ..functions.templates import compile_templates
from ..operators import arrow
from ..operators.tokenizer import Tokenizer
from ..sources import snapshot
from ..sources.spec import TokenizerSpec
from .offsets import running_offsets
from .storage import stored

FOLD_LIMIT = 500  # merges that one expression folds over
FEW_BATCHES = 1 << 16  # batches whose longest lengths are broadcast


class Engine:
    """One specification, as expressions. Immutable: with_* return another engine."""

    def __init__(self, spec: TokenizerSpec):
        self.spec = spec
        self.tokenizer = Tokenizer(spec)  # checks all of the specification on the driver

    @classmethod
    def from_file(cls, path: str, cached: bool = False) -> Engine:
        """Of a tokenizer.json, with `cached` by way of its snapshot; of a snapshot, always so."""
        if cached or str(path).endswith(snapshot.SUFFIX):
            return cls(snapshot.load_or_create(path))
        return cls(TokenizerSpec.from_file(path))

    @classmethod
    def from_buffer(cls, buffer: bytes) -> Engine:
        return cls(TokenizerSpec.from_json(buffer))

    @classmethod
    def from_json(cls, text: str) -> Engine:
        return cls(TokenizerSpec.from_json(text))

    def with_truncation(self, *args, **options) -> Engine:
        return Engine(self.spec.with_truncation(*args, **options))

    def with_padding(self, *args, **options) -> Engine:
        return Engine(self.spec.with_padding(*args, **options))

    def with_normalizer(self, config: dict | None) -> Engine:
        return Engine(self.spec.with_normalizer(config))

    def with_post_processor(self, config: dict | str | None) -> Engine:
        return Engine(self.spec.with_post_processor(config))

    # stages

    def normalized(self, text: Column) -> Column:
        """The normalizer; the empty text passes as it is."""
        native = _normalizer(self.spec.normalizer)
        return arrow.normalized(text, self.spec) if native is None else F.when(text == "", text).otherwise(native(text))

    def pieces(self, text: Column) -> Column:
        """array<struct<text, token_id>>; added tokens have their id, other pieces null."""
        native = self._native_pieces()
        if native is None:
            return arrow.pieces(text, self.spec)
        return F.transform(native(text), lambda p: F.struct(p.alias("text"), F.lit(None).cast("int").alias("token_id")))

    def _native_pieces(self):
        normalize, split = _normalizer(self.spec.normalizer), _pre_tokenizer(self.spec.pre_tokenizer)
        if self.spec.added_tokens or normalize is None or split is None:
            return None
        return lambda text: F.when(text == "", F.array().cast("array<string>")).otherwise(C.let(normalize(text), split))

    def content(self, text: Column) -> Column:
        """array<int>: pieces that Catalyst splits go to the model as they are."""
        native = self._native_pieces()
        return arrow.ids(text, self.spec, False) if native is None else arrow.pieces_ids(native(text), self.spec)

    def ids(self, text: Column, add_special_tokens: bool = True) -> Column:
        """array<int>: ids of the whole text, without truncation or padding."""
        return self.post_process(self.content(text), add_special_tokens)

    def checked_ids(self, text: Column, add_special_tokens: bool = True) -> Column:
        """Struct (ids, error) for rows that may hold what the model rejects."""
        return arrow.ids_or_error(text, self.spec, add_special_tokens)

    def post_process(self, ids: Column, add_special_tokens: bool = True) -> Column:
        for t in compile_templates(self.spec.post_processor) if add_special_tokens else ():
            ids = ids if t.is_identity else F.when(ids.isNotNull(), C.template(ids, t.parts))
        return ids

    def post_process_encoding(self, encoding: Column, add_special_tokens: bool = True) -> Column:
        """The templates around an encoding; what describes its ids is made anew, and it stays
        marked as truncated."""
        own = F.struct(self.post_process(encoding["ids"], add_special_tokens).alias("ids"), encoding["truncated"].alias("truncated"))
        every = lambda e, x: F.transform(e["ids"], lambda _: F.lit(x))
        made = C.let(own, lambda e: F.struct(
            e["ids"].alias("ids"), every(e, 1).alias("attention_mask"), every(e, 0).alias("type_ids"), every(e, 0).alias("special_tokens_mask"),
            F.lit(1).alias("n_sequences"), e["truncated"].alias("truncated"),
        ))
        return F.when(encoding.isNotNull(), made)

    def rejected(self, text: Column) -> Column:
        """Why the model rejects a text, or null; nothing is merged."""
        return arrow.rejections(text, self.spec)

    def has_candidate(self, text: Column) -> Column:
        """Whether a text may hold an added token, for a filter before the segmentation. Tokens that are
        looked for in normalized text may be in any."""
        if any(t.normalized for t in self.spec.added_tokens):
            return F.lit(True)
        return reduce(or_, [F.contains(text, F.lit(t.content)) for t in self.spec.added_tokens if t.content], F.lit(False))

    def is_special(self, token_id: Column) -> Column:
        """Whether an id is that of a special added token."""
        return token_id.isin(sorted(self.tokenizer.added.special))

    def with_limit(self, text: Column, most: int, direction: str = "right") -> Column:
        return arrow.limited(text, self.spec, most, direction)

    def encode(self, text: Column, add_special_tokens: bool = True, pad: bool = True) -> Column:
        """Struct of an encoding, padded row by row: a worker gives the ids, and the lists beside them are Catalyst's."""
        own = arrow.truncated(text, self.spec, add_special_tokens)
        return self._padded(own, None) if pad and self.spec.padding else F.when(own.isNotNull(), C.encoding(own["ids"], own["truncated"]))

    def _padded(self, own: Column, longest: Column | None) -> Column:
        """The encoding of (ids, truncated), padded as the specification says."""
        p = self.spec.padding
        target = C.pad_target(F.size(own["ids"]), p.length if p.length is not None else longest, p.pad_to_multiple_of)
        return F.when(own.isNotNull(), C.pad_encoding(C.encoding(own["ids"], own["truncated"]), target, p.direction, p.pad_id, p.pad_type_id))

    def decode(self, ids: Column, skip_special_tokens: bool = False) -> Column:
        return arrow.decoded(ids, self.spec, skip_special_tokens)

    def decode_tokens(self, tokens: Column) -> Column:
        return arrow.decoded_tokens(tokens, self.spec)

    # tables

    def encode_batch(self, df: DataFrame, text_col: str = "text", batch_col: str | None = None, out: str = "encoding", add_special_tokens: bool = True) -> DataFrame:
        """df with an encoding for each row. Where padding goes to the longest row, that is the longest
        of the rows with the same batch_col; the ids alone are stored, the longest lengths are found by
        a combined aggregate and joined back, so a batch may be of any size: where there are few batches their
        lengths go to all rows, where there are many the rows go to them."""
        p = self.spec.padding
        if p is None or p.length is not None or batch_col is None:
            return df.withColumn(out, self.encode(F.col(text_col), add_special_tokens))
        own = stored(df.withColumn(out, arrow.truncated(F.col(text_col), self.spec, add_special_tokens)))
        longest = stored(own.groupBy(F.col(batch_col).alias("__batch")).agg(F.max(F.size(F.col(out).ids)).alias("__longest")))
        longest = F.broadcast(longest) if longest.limit(FEW_BATCHES + 1).count() <= FEW_BATCHES else longest
        own = own.join(longest, F.col(batch_col).eqNullSafe(F.col("__batch")))
        return own.withColumn(out, self._padded(F.col(out), F.col("__longest"))).drop("__batch", "__longest")

    def ragged(self, df: DataFrame, key_col: str, text_col: str = "text", add_special_tokens: bool = True) -> DataFrame:
        """key, pos, token_id: a row for each id, in the long form of a ragged batch."""
        return df.select(key_col, F.posexplode(self.ids(F.col(text_col), add_special_tokens)).alias("pos", "token_id"))

    def flat(self, df: DataFrame, key_col: str, text_col: str = "text", add_special_tokens: bool = True) -> DataFrame:
        """key, ids, start, end: where each row's ids lie in the concatenation in the order of key, which may
        be of any type that orders and have any name but these three. Truncation applies, padding doesn't."""
        if key_col in ("ids", "start", "end"):
            raise ValueError(f"the key can't be named {key_col}: the result has a column of that name")
        t = self.spec.truncation
        ids = self.ids(F.col(text_col), add_special_tokens) if t is None else arrow.truncated(F.col(text_col), self.spec, add_special_tokens)["ids"]
        own = df.select(F.col(key_col), ids.alias("ids")).withColumn("__n", F.size("ids").cast("long"))
        return running_offsets(own, key_col, "__n").drop("__n")

    def vocab(self, spark: SparkSession, with_added_tokens: bool = True) -> DataFrame:
        """token, id."""
        return spark.createDataFrame(list(self.tokenizer.vocab(with_added_tokens).items()), "token string, id int")

    def merges(self, spark: SparkSession) -> DataFrame:
        """rank, left, right; empty for a Unigram model."""
        rows = [(r, a, b) for r, (a, b) in enumerate(getattr(self.spec.model, "merges", ()))]
        return spark.createDataFrame(rows, "rank int, left string, right string")

    def save_vocabulary(self, spark: SparkSession, folder: str, prefix: str | None = None) -> str:
        """Write the vocabulary as <prefix>-vocab.json, through the file system that the folder names."""
        path = f"{folder}/{prefix + '-' if prefix else ''}vocab.json"
        jvm = spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
        try:
            out.write(json.dumps(self.tokenizer.vocab(), ensure_ascii=False).encode())
        finally:
            out.close()
        return path

    def added_tokens(self, spark: SparkSession) -> DataFrame:
        rows = [(t.id, t.content, t.single_word, t.lstrip, t.rstrip, t.normalized, t.special) for t in self.spec.added_tokens]
        return spark.createDataFrame(rows, "id int, content string, single_word boolean, lstrip boolean, rstrip boolean, normalized boolean, special boolean")

    def bridges(self, spark: SparkSession) -> DataFrame:
        """before, after: the pairs of bytes that some token has side by side; empty where none apply."""
        rows = sorted(getattr(self.tokenizer.model, "bridges", None) or ())
        return spark.createDataFrame(rows, "before int, after int")

    def register(self, spark: SparkSession, prefix: str = "tf") -> None:
        """SQL functions <prefix>_encode(text), <prefix>_decode(ids), <prefix>_token(id), and the table function
        <prefix>_tokens(text) -> (pos, token_id, token), which is SQL over them: texts pass in batches."""
        doc = self.spec.to_json()

        @F.arrow_udf("array<int>")
        def encode(column):
            return arrow.ids_of(column, arrow.tokenizer_of(doc))

        @F.arrow_udf("string")
        def decode(column):
            return arrow.texts_of(column, arrow.tokenizer_of(doc))

        @F.arrow_udf("string")
        def token(column):
            return arrow.pa.array([None if i is None else arrow.tokenizer_of(doc).id_to_token(i) for i in column.to_pylist()], arrow.pa.string())

        spark.udf.register(f"{prefix}_encode", encode)
        spark.udf.register(f"{prefix}_decode", decode)
        spark.udf.register(f"{prefix}_token", token)
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}_tokens(content STRING) RETURNS TABLE (pos INT, token_id INT, token STRING) "
            f"RETURN SELECT p, i, {prefix}_token(i) FROM posexplode({prefix}_encode(content)) AS ids(p, i)"
        )

    def plan(self) -> dict[str, str]:
        """The engine of each stage: catalyst or arrow."""
        at = lambda native: "arrow" if native is None else "catalyst"
        model = self.spec.model
        fold = model.kind == "BPE" and not model.byte_fallback and len(model.merges) <= FOLD_LIMIT and C.is_rank_topological(model.merges)
        return {
            "added_tokens": "arrow" if self.spec.added_tokens else "none", "normalizer": at(_normalizer(self.spec.normalizer)), "pre_tokenizer": at(_pre_tokenizer(self.spec.pre_tokenizer)),
            "model": "arrow, or a catalyst fold" if fold else "arrow", "post_processor": "catalyst", "decoder": "arrow",
        }

    def encode_pair(self, *_):
        raise UnsupportedError("pairs of sequences and pretokenized input")


def _normalizer(config: dict | None):
    """A function from column to column, or None where only the Arrow form is exact."""
    if config is None:
        return lambda text: text
    if config["type"] == "Replace":
        kind, pattern = pattern_of(config.get("pattern"))
        if kind == "String":
            return lambda text: C.replace_literal(text, pattern, config["content"])
        return (lambda text: C.replace_regex(text, pattern, config["content"])) if C.has_width(pattern) else None
    if config["type"] == "Sequence":
        steps = [_normalizer(x) for x in config["normalizers"]]
        if None in steps:
            return None

        def run(text: Column) -> Column:
            for step in steps:
                text = step(text)
            return text

        return run
    return None


def _pre_tokenizer(config: dict | None):
    if config is None:
        return lambda text: F.array(text)
    kind = config["type"]
    if kind == "WhitespaceSplit":
        return C.whitespace_split
    if kind == "Metaspace":
        mark, scheme, parts = metaspace_options(config)
        return lambda text: C.metaspace(text, mark, scheme, parts)
    if kind == "Split":
        (how, pattern), = config["pattern"].items()
        behavior, invert = config["behavior"], bool(config.get("invert"))
        if how == "String":
            return lambda text: C.split(text, pattern, behavior, invert, literal=True)
        if name_of(pattern) or C.has_width(pattern):
            return lambda text: C.split(text, pattern, behavior, invert)
        return None
    if kind == "Sequence":
        steps = [_pre_tokenizer(x) for x in config["pretokenizers"]]
        if None in steps:
            return None

        def run(text: Column) -> Column:
            pieces = F.array(text)
            for step in steps:
                pieces = C.each(pieces, step)
            return pieces

        return run
    return None  # byte level: its characters are a worker's; byte_hex has the same symbols natively
