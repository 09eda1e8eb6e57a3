"""Token counts of whole texts with a whole-token shortcut (operator 9).

Most pre-tokens of ordinary text are vocabulary strings that encode alone as
one token. That set is proved before the job runs: a vocabulary string belongs
to it if the library gives one token for it. Pre-tokens in the set count
directly; only the rest go through merges, each distinct one once while it is
remembered.

No token and no normalisation reaches across a blank, tab or line end. Between
two of these, strings with characters for which this module's pre-tokenisation
isn't proved to equal the library's (beyond U+024F, control characters that only
one of the two takes for white space, or strings of special tokens) are counted
by the library, each distinct one once while it is remembered; the rest of such
a text takes the shortcut. So counts are the library's for every text.

Defined results: null and empty texts have 0 bytes and 0 tokens.
"""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pdengine.llm.tables import slices

#: Distinct merged pre-tokens that a worker remembers.
REMEMBERED = 400_000
#: Characters that the pattern below classes as the library does.
_KNOWN = re.compile("[\t-\r -~\x85\xa0-\u024f]*")
_BLANKS = re.compile("[ \t\n\r]+")
_NUMBERS = "\\d\u00b2\u00b3\u00b9\u00bc-\u00be"
_PRETOKENS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[^\\W_{_NUMBERS}]+|[{_NUMBERS}]|(?:[^\\s\\w]|_)+")


class Counter:
    """Counts tokens as the library does for one ``tokenizers`` file with word ends."""

    def __init__(self, path: str, whole: list[str] | None = None):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.one = dict.fromkeys(self.whole_tokens() if whole is None else whole, 1)
        self.merged: dict[str, int] = {}
        self.odd: dict[str, int] = {}

    def whole_tokens(self) -> list[str]:
        """Vocabulary strings that, standing alone, are one pre-token and encode as one token."""
        names = (t.removesuffix("</w>") for t in self.library.get_vocab(with_added_tokens=False) if t.endswith("</w>"))
        plain = sorted({n for n in names if n.isascii() and n and _PRETOKENS.fullmatch(n)})
        return [n for n, k in zip(plain, self._merge(plain), strict=True) if k == 1]

    def _merge(self, pretokens: list[str]) -> list[int]:
        """Tokens of each pre-token: encoded in one text with blanks between, told apart by their offsets."""
        if not pretokens:
            return []
        joined = " ".join(pretokens)
        ends = np.cumsum([len(p) + 1 for p in pretokens])
        got = self.library.encode(joined, add_special_tokens=False)
        starts = np.array([a for a, _ in got.offsets], np.int64)
        counts = np.bincount(np.searchsorted(ends, starts, "right"), minlength=len(pretokens))
        return counts.tolist()

    def pretokens(self, text: str) -> tuple[list[str], list[str]]:
        """The library's pre-tokens, and strings between blanks that only the library can tell."""
        odd: list[str] = []
        if not _plain(text):
            pieces = _BLANKS.split(text)
            odd = [p for p in pieces if not _plain(p)]
            text = " ".join([p for p in pieces if _plain(p)])
        return _PRETOKENS.findall(unicodedata.normalize("NFC", text).lower()), odd

    def __call__(self, texts: list[str]) -> list[int]:
        split = [self.pretokens(t) for t in texts]
        for held in (self.merged, self.odd):
            if len(held) > REMEMBERED:
                held.clear()
        one, merged, odd = self.one, self.merged, self.odd
        rest = list({p for words, _ in split for p in words if p not in one and p not in merged})
        merged.update(zip(rest, self._merge(rest), strict=True))
        alone = list({p for _, pieces in split for p in pieces if p not in odd})
        if alone:
            odd.update(zip(alone, [len(e.ids) for e in self.library.encode_batch(alone, add_special_tokens=False)], strict=True))
        return [sum([one.get(p) or merged[p] for p in words]) + sum([odd[p] for p in pieces]) for words, pieces in split]


def _plain(text: str) -> bool:
    """Whether this module's pre-tokens of a text are proved to be the library's."""
    return bool(_KNOWN.fullmatch(text)) and "<|" not in text and "\u0130" not in text


_counters: dict[str, Counter] = {}


def _task(path: str, whole: str):
    def task(batches):
        if path not in _counters:
            _counters[path] = Counter(path, whole.split("\n"))
        count = _counters[path]
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(count(texts), pa.int64())],
                    names=["doc_id", "n_bytes", "n_tokens"],
                )

    return task


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row of ``docs``, by the vocabulary file at ``path``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if path not in _counters:
        _counters[path] = Counter(path)
    whole = "\n".join(_counters[path].one)  # proved here, once; bounded by the vocabulary
    counted = rows.mapInArrow(_task(path, whole), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
