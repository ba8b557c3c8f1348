"""Token counts of whole texts, with overlap resynchronisation for huge ones.

Short texts are counted as the sum of their words, runs of anything but ASCII white space: the library's normaliser
composes nothing with white space and turns runs of it into a space, its pre-tokens hold none and look no further than
themselves, and neither does a special token. So words count alone as they count in the text, and each different word
goes to the library once, as far as a table of bounded size remembers it. A huge text is cut into overlapping chunks; each is encoded on its own,
with offsets. Two neighbours are spliced at a stable common boundary: a position in the overlap where both
encodings have a token boundary that is also a pre-token boundary, and from which on (left chunk) or up to which
(right chunk) both have the same tokens for `PROOF` tokens each way. The tokeniser merges only inside pre-tokens,
and its pre-tokens look no further than the next character, so from such a point on the encodings agree. Where
an overlap has no such point (one unbroken word, say), it is widened and the right chunk encoded again, in the end
up to the whole rest of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 16
OVERLAP = 1 << 10
PROOF = 4
#: Words that are remembered, and the bytes of the longest of them.
KNOWN_WORDS = 600_000
KNOWN_LENGTH = 64


class _Words(dict):
    """Word (UTF-8) to its number of tokens, as far as known; others are encoded when they are asked for.

    Known words are kept in two generations, as those of `byte_bpe.Encoder`."""

    def __init__(self, tokenizer):
        super().__init__()
        self.encode, self.old = tokenizer.encode_batch_fast, {}

    def __missing__(self, word: bytes) -> int:
        n = self.old.get(word)
        if n is None:
            n = len(self.encode([word.decode("utf-8")], add_special_tokens=False)[0])
        if len(word) <= KNOWN_LENGTH:
            if len(self) >= KNOWN_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = n
        return n


class Counter:
    """Counts tokens with a `tokenizers` file; special tokens are neither added nor treated apart from the default."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.chunk, self.overlap = chunk, overlap
        self.words = _Words(self.tokenizer)

    def short(self, text: str) -> int:
        """The count of a short text."""
        return sum(map(self.words.__getitem__, text.encode("utf-8").split()))

    def _encode(self, text: str, start: int, stop: int) -> tuple[list[int], list[int], list[int]]:
        """Ids, and where each token starts and ends in the whole text."""
        e = self.tokenizer.encode(text[start:stop], add_special_tokens=False)
        return e.ids, [start + a for a, _ in e.offsets], [start + b for _, b in e.offsets]

    @staticmethod
    def _splice(left, right, text: str) -> tuple[int, int] | None:
        """Positions (i, j): the left tokens before i and the right ones from j on are the whole's."""
        ids, begins, ends = left
        other, others, other_ends = right
        at = {}
        for j, b in enumerate(others):
            at.setdefault(b, j)  # the first token that starts there; bytes of one character share a start
        # From the middle of the overlap outwards, so that both sides have seen as much as possible.
        middle = (others[0] + ends[-1]) // 2
        for i in sorted(range(PROOF, len(ids) - PROOF + 1), key=lambda i: abs(begins[i] - middle)):
            b = begins[i]
            if b < others[0] or begins[i - 1] == b:
                continue
            j = at.get(b)
            if j is None or j < PROOF or j + PROOF > len(other):
                continue
            # White space stands before the boundary: no pre-token and no merge crosses it.
            if text[b - 1] not in " \n\r\t" or ends[i - 1] > b:
                continue
            same = all(
                ids[i + k] == other[j + k] and begins[i + k] == others[j + k] and ends[i + k] == other_ends[j + k]
                for k in range(-PROOF, PROOF)
            )
            if same:
                return i, j
        return None

    def one(self, text: str) -> int:
        """The count of a text of any length."""
        if len(text) <= self.chunk:
            return self.short(text)
        start, stop = 0, self.chunk
        left = self._encode(text, start, stop)
        total = 0
        while stop < len(text):
            overlap = self.overlap
            while True:
                begin = max(start, stop - overlap)
                end = min(len(text), max(begin + self.chunk, stop + overlap))
                right = self._encode(text, begin, end)
                met = self._splice(left, right, text) if left[0] and right[0] else None
                if met:
                    break
                if begin == start:  # the whole left chunk is overlap and has no common boundary: take both as one
                    right = self._encode(text, start, end)
                    met = (0, 0)
                    break
                overlap *= 4
            i, j = met
            total += i
            left = tuple(x[j:] for x in right)
            start, stop = (left[1][0] if left[1] else begin), end
        return total + len(left[0])


@lru_cache(maxsize=1)
def _counter(path: str, chunk: int, overlap: int) -> Counter:
    """The counter of this worker process, which lives on from task to task."""
    return Counter(path, chunk, overlap)


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 2048,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    Null and empty texts have no bytes and no tokens. Texts beyond `chunk` characters are counted in overlapping
    chunks. Repeated rows are counted each; other columns are ignored. `tokenizer_path` must be readable on every
    executor.
    """
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer_path, chunk, overlap)
        for batch in batches:
            counts = [counter.one(t) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"))
    out = rows.mapInArrow(run, f"id {kind.simpleString()}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
