"""Token counts of whole texts without a shuffle.

Texts are split into pre-tokens as the tokenizer does. Their lengths in tokens come from two tiers: a compact table of
frequent pre-tokens, broadcast (at most FREQUENT entries, from a bounded sample; it affects speed only), then each
worker's own cache, filled by encoding what it misses. Texts that the fast split may not reproduce (special tokens,
characters outside well-known ranges) go whole through the library.

Defined results: a null text counts as empty (0 bytes, 0 tokens); doc_ids may be null or repeat; an empty table gives no
rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_DOCS, SAMPLE_BYTES, FREQUENT, CACHED, LONGEST, TOKEN_LIMIT = 2_000, 16_384, 20_000, 300_000, 64, 512
#: Fixed value: the byte-level pre-token pattern that the public tokenizer file stands for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters on whose classes regular-expression libraries and Unicode versions agree.
PLAIN = r"[\t\n\r -~¡-ɏΑ-ΡΣ-ωА-яぁ-ゖァ-ヺ一-龥가-힣‐-‧€]*"

_workers: dict[str, tuple] = {}


def _worker(path: str):
    """This process's tokenizer, patterns and cache for the file."""
    if path not in _workers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        special = [t.content for t in tok.get_added_tokens_decoder().values()]
        _workers[path] = (tok, regex.compile(PATTERN).findall, regex.compile(PLAIN).fullmatch, special, {}, _pieces(tok, set(special)))
    return _workers[path]


def _pieces(tok, special: set[str]):
    """A function from a pre-token's bytes to its ids, by the tokenizer's own vocabulary: ids of a byte-level BPE are its merge ranks."""
    import tiktoken

    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
    others = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(others)}
    ranks = {bytes(byte[c] for c in t): i for t, i in tok.get_vocab().items() if t not in special}
    return tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


def count_tokens(texts: list[str | None], path: str, frequent: dict[str, int]) -> list[int]:
    tok, split, plain, special, cache, piece = _worker(path)
    out = []
    for text in texts:
        if not text:
            out.append(0)
        elif not plain(text) or any(s in text for s in special):
            out.append(len(tok.encode(text, add_special_tokens=False).ids))
        else:
            n = 0
            for t in split(text):
                if (k := frequent.get(t) or cache.get(t)) is None:
                    k = len(piece(t.encode()))
                    if len(t) <= LONGEST:
                        if len(cache) >= CACHED:
                            cache.clear()
                        cache[t] = k
                n += k
            out.append(n)
    return out


def sampled_words(docs: DataFrame, path: str) -> DataFrame:
    """word, n: pre-tokens of about SAMPLE_DOCS rows of at most SAMPLE_BYTES, one row in so many by hash from all files.

    They are counted where they are and summed by word; no text leaves its task.
    """
    every = max(1, docs.count() // SAMPLE_DOCS)
    sample = docs.where((F.octet_length("text") <= SAMPLE_BYTES) & (F.pmod(F.xxhash64("doc_id", "text"), F.lit(every)) == 0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, split = Counter(), _worker(path)[1]
        for b in batches:
            for t in b.column("text").to_pylist():
                found.update(x for x in split(t) if len(x) <= LONGEST)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])

    return sample.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_lengths(docs: DataFrame, path: str) -> dict[str, int]:
    """Lengths in tokens of the FREQUENT most frequent pre-tokens of the sample."""
    tok = _worker(path)[0]
    top = [r["word"] for r in sampled_words(docs, path).orderBy(F.desc("n"), "word").limit(FREQUENT).collect()]
    return dict(zip(top, (len(e.ids) for e in tok.encode_batch(top, add_special_tokens=False)), strict=True))


def token_counts(docs: DataFrame, path: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row."""
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path))

    @F.pandas_udf("long")
    def n_tokens(texts: pd.Series) -> pd.Series:
        return pd.Series(count_tokens(texts.tolist(), path, table.value), dtype="int64")

    n = F.col("n_tokens")
    counted = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), n_tokens("text").alias("n_tokens"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (n > limit).alias("over_limit"))
