"""Token counts of a byte-level BPE by the whole-token shortcut.

Offline, on the driver, every string of the vocabulary is encoded by itself; those that come back as one token are proved
whole: as a pre-token such a string always counts 1, for merges never look beyond a pre-token. In the tasks, texts are cut
to pre-tokens by the tokenizer's public pattern; whole ones count 1 by a set lookup, and only the rest, each different
one once in a batch, goes through the merges. The set's size is bounded by the vocabulary's.

The pattern runs in the `regex` library, whose Unicode tables may be of another version than the tokenizer's; offline, the
code points of SAFE are tried in both, and a text with any other goes through the tokenizer whole. A special token's string inside a text
is that token, as the library's default has it.

Defined results: null text counts as empty: 0 bytes and 0 tokens. Rows are kept one for one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import mapped

LIMIT = 512
#: The public pre-token pattern of byte-level BPE: a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Ranges of code points worth the trial: Latin to Cyrillic, Hebrew and Arabic, punctuation and signs, kana, Han, Hangul.
SAFE = ((0x80, 0x52F), (0x590, 0x6FF), (0x2000, 0x2BFF), (0x3000, 0x30FF), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3), (0x1F300, 0x1F64F))
#: Counts of merged pre-tokens that a worker keeps, beside those of the texts at hand.
REMEMBERED = 400_000


def _byte_letters() -> dict[str, int]:
    """Byte-level BPE writes bytes as letters: printable ones as themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def whole_tokens(tokenizer: Tokenizer) -> list[str]:
    """The vocabulary's strings that are proved to encode alone as one token."""
    letters, special = _byte_letters(), {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    texts = []
    for piece in tokenizer.get_vocab(with_added_tokens=False):
        if piece not in special and all(c in letters for c in piece):
            try:
                texts.append(bytes(letters[c] for c in piece).decode())
            except UnicodeDecodeError:
                continue
    one = [t for t, e in zip(texts, tokenizer.encode_batch_fast(texts, add_special_tokens=False)) if len(e.ids) == 1]
    cut = regex.compile(PATTERN)
    return [t for t in one if cut.fullmatch(t) and cut.findall(t) == [t]]


def agreed_code_points(tokenizer: Tokenizer) -> str:
    """Of SAFE, the code points that the pattern's classes hold as the tokenizer does: each is tried beside a letter, a digit and a mark."""
    points = [chr(c) for lo, hi in SAFE for c in range(lo, hi + 1)]
    cut, good = regex.compile(PATTERN), []
    for c in points:
        text = f"a{c}1{c}!{c}"
        if [span for _, span in tokenizer.pre_tokenizer.pre_tokenize_str(text)] == [m.span() for m in cut.finditer(text)]:
            good.append(ord(c))
    runs = []
    for c in good:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


def count_tokens(docs: DataFrame, tokenizer_file: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row."""
    tokenizer = Tokenizer.from_file(tokenizer_file)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    known = docs.sparkSession.sparkContext.broadcast((tokenizer.to_str(), whole_tokens(tokenizer), agreed_code_points(tokenizer), special))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spec, whole, agreed, special = known.value
        tok = Tokenizer.from_str(spec)
        cut = regex.compile(PATTERN).findall
        differs = regex.compile(f"[^\\x00-\\x7f{agreed}]").search
        split = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))).split if special else (lambda t: [t])
        known_ = dict.fromkeys(whole, 1)
        for pdf in batches:
            counts = []
            for lo in range(0, len(pdf), 256):
                if len(known_) > len(whole) + REMEMBERED:
                    known_ = dict.fromkeys(whole, 1)
                texts = [t or "" for t in pdf["text"].iloc[lo : lo + 256]]
                plain = [None if differs(t) else split(t) for t in texts]
                tokens = [None if p is None else [w for s in p for w in cut(s)] for p in plain]
                rest = list({w for ws in tokens if ws is not None for w in ws if w not in known_})
                known_.update(zip(rest, (len(e.ids) for e in tok.encode_batch_fast(rest, add_special_tokens=False))))
                get = known_.__getitem__
                for t, p, ws in zip(texts, plain, tokens):
                    counts.append(len(tok.encode(t, add_special_tokens=False).ids) if ws is None else sum(map(get, ws)) + len(p) - 1)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_bytes": pdf["n_bytes"], "n_tokens": counts})

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = mapped(rows, run, "doc_id long, n_bytes long, n_tokens long", "doc_id")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
