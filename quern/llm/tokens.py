"""Token counts by overlap resynchronisation.

A text of at most `chunk` bytes is encoded in one go. A longer one is encoded in overlapping chunks
with offsets; neighbours are spliced at a token boundary that both encodings have and that is proven
stable, and the overlap is widened where there is none, up to the rest of the text.

Proof for byte-level BPE with the usual splitting pattern: the pattern reads from left to right, has
no look-behind, and no alternative crosses the place before a single space that a non-space follows
(a run of white space before a word gives up its last character). So the tokens left of such a place
do not depend on what is right of it, nor the other way round, and merges stay inside one match.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm.shared import texts

#: Bytes of a chunk and of the first overlap.
CHUNK, OVERLAP = 1 << 16, 1 << 10


def spliced(data, encode, stable, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
    """Ids of the whole of data. encode(a, b): ids and their start offsets for data[a:b], the offsets
    absolute; stable(p): whether tokens left and right of p are independent, whatever the context."""
    n, out, begin, left = len(data), [], 0, 0
    ids, starts = encode(0, min(n, chunk + overlap))
    end = min(n, chunk + overlap)
    while end < n:
        nxt, wide = begin + chunk, overlap
        while True:
            ids2, starts2 = encode(nxt, min(n, nxt + chunk + wide))
            common = np.intersect1d(starts[starts > max(nxt, left)], starts2[starts2 < end], assume_unique=True)
            seam = next((p for p in common.tolist() if stable(p)), None)
            if seam is not None:
                break
            if end >= n:
                return np.concatenate([*out, ids[starts >= left]])
            wide *= 2
            ids, starts = encode(begin, end := min(n, nxt + wide))
        out.append(ids[(starts >= left) & (starts < seam)])
        ids, starts, begin, left, end = ids2, starts2, nxt, seam, min(n, nxt + chunk + wide)
    return np.concatenate([*out, ids[starts >= left]])


class ByteBpe:
    """Byte-level BPE of a tokenizers .json file: words between spaces are looked up, new ones encoded.

    Ids equal those of the tokenizers library without added tokens; its special strings inside a text
    become their special ids, as is the library's default."""

    LIMIT = 400_000

    def __init__(self, spec: dict, chunk: int, overlap: int):
        import re

        import public_tokenizers
        import tiktoken

        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(printable)]
        to_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        ranks = {bytes(to_byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max([*ranks.values(), *special.values()]) + 1, np.int64)
        for token, i in ranks.items():
            self.lengths[i] = len(token)
        self.special = special
        self.cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.chunk, self.overlap, self.words, self.sizes = chunk, overlap, {"": None}, {"": None}

    @classmethod
    def fits(cls, spec: dict) -> bool:
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = all(not x.get(k) for x in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word"))
        if model.get("type", "BPE") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer") or not plain:
            return False
        made = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        return None not in made and all(a < b for a, b in zip(made, made[1:], strict=False))

    def _new(self, word: str):
        if word[0].isspace():
            return None  # a space before white space is no stable boundary
        if len(self.words) >= self.LIMIT:
            self.words.clear()
            self.words[""] = None
        found = self.words[word] = np.array(self.encoding.encode_ordinary(" " + word), "<u4").tobytes()
        return found

    def _plain(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text without special strings."""
        if len(text) > self.chunk // 4 and len(data := text.encode("utf-8", "replace")) > self.chunk:
            return self._huge(data).astype("<u4").tobytes()
        first, *rest = text.split(" ")
        words, out = self.words, [np.array(self.encoding.encode_ordinary(first), "<u4").tobytes()]
        try:
            for w in rest:
                out.append(words.get(w) or self._new(w))
            return b"".join(out)
        except (TypeError, IndexError):
            return np.array(self.encoding.encode_ordinary(text), "<u4").tobytes()

    def _huge(self, data: bytes) -> np.ndarray:
        def whole(p: int) -> int:
            while 0 < p < len(data) and data[p] & 0xC0 == 0x80:
                p -= 1
            return p

        def encode(a: int, b: int):
            a, b = whole(a), whole(b)
            ids = np.array(self.encoding.encode_ordinary(data[a:b].decode("utf-8", "replace")), np.int64)
            return ids, a + np.r_[0, np.cumsum(self.lengths[ids])[:-1]] if len(ids) else np.zeros(0, np.int64)

        return spliced(data, encode, lambda p: data[p] == 32 and p + 1 < len(data) and 33 <= data[p + 1] < 127, self.chunk, self.overlap)

    def ids(self, text: str) -> bytes:
        if self.cut and any(s in text for s in self.special):
            return b"".join(np.array([self.special[p]], "<u4").tobytes() if p in self.special else self._plain(p) for p in self.cut.split(text) if p)
        return self._plain(text) if text else b""

    def count(self, text: str) -> int:
        return len(self.ids(text)) // 4


class Library:
    """Any other .json by tokenizers, or a .model by sentencepiece, over whole texts.

    Their normalisers may look at a whole text, so no boundary is proven and none is spliced."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda text: model.encode(text, num_threads=1)
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            self.encode = lambda text: model.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> bytes:
        return np.array(self.encode(text), "<u4").tobytes() if text else b""

    def count(self, text: str) -> int:
        return len(self.encode(text)) if text else 0


_loaded: dict = {}


def tokenizer(path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
    """The tokenizer of a file, loaded once for each Python worker."""
    if (key := (path, chunk, overlap)) not in _loaded:
        spec = json.loads(open(path, encoding="utf-8").read()) if path.endswith(".json") else None
        _loaded[key] = ByteBpe(spec, chunk, overlap) if spec and ByteBpe.fits(spec) else Library(path)
    return _loaded[key]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(docs: DataFrame, name: str = "byte_bpe_50k.json", limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have no bytes and no tokens; a null id stays null; repeated rows are counted
    each; an empty table gives an empty result; other columns of docs are left out. `name` is a file
    of the public tokenizers, whose place each worker looks up for itself. No shuffle."""

    def run(batches):
        t = tokenizer(vocabulary(name), chunk, overlap)
        for batch in batches:
            values = batch.column("text").to_pylist()
            n = np.fromiter(map(t.count, values), np.int64, len(values))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts(docs, id_col, text_col).selectExpr("doc_id", "cast(octet_length(text) as long) n_bytes", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
