"""Tokenizers over Arrow columns: texts are cut where no token can cross, and each distinct segment of a batch is encoded once.

Segments. For tokenizers whose pre-tokenizer never joins anything across a
space or line feed (word_bpe), a text is cut at each of those. For
sentencepiece models without a piece that holds a space after another
character (checked when the model is loaded), a text is cut at the first space
of each run; that space comes back as the prefix that the model adds to every
text. Everything else goes to the library as one segment, so results are the
library's own on whole texts.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import keeps, ragged
from .shingles import span_hashes

#: Segments kept with their ids by a worker before it starts anew; about 30 bytes each.
MEMO = 800_000
#: Text bytes that one call handles at most (one longer text is a call of its own).
SLICE_BYTES = 1 << 20


def _cuts_at_space(spec: dict) -> bool:
    """Whether no token or special token can hold or cross a space or line feed."""
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    splits = [p for p in pre if p.get("type") == "Split" and p.get("behavior") == "Removed" and p.get("invert")]
    special = all(not re.search(r"\s", t["content"]) and not t["lstrip"] and not t["rstrip"] for t in spec.get("added_tokens", []))
    return special and any(p["pattern"].get("Regex", "").endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") for p in splits)


def _own(texts: pa.Array) -> pa.Array:
    """A copy that starts at offset 0, without nulls: pyarrow's string kernels mistake the offsets of slices."""
    return pc.fill_null(pa.concat_arrays([texts, pa.array([], texts.type)]).cast(pa.large_string()), "")


class Memo:
    """ids of segments by 64-bit hash, in arrays: a dict of strings would take five times the memory."""

    def __init__(self) -> None:
        self.keys = np.empty(0, np.uint64)  # ascending
        self.entries = np.empty(0, np.int32)
        self.starts = np.zeros(1, np.int64)  # of entry i in ids; the next entry's is its end
        self.ids = np.empty(1 << 16, np.uint32)

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Entry of each key, -1 if it isn't there."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.entries[at], np.int32(-1))

    def add(self, keys: np.ndarray, lists: list[list[int]]) -> None:
        ends = self.starts[-1] + np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))
        used, need = int(self.starts[-1]), int(ends[-1])
        if need > len(self.ids):
            self.ids = np.concatenate([self.ids[:used], np.empty(need + need // 4 - used, np.uint32)])
        self.ids[used:need] = np.fromiter((i for x in lists for i in x), np.uint32, need - used)
        entries = np.arange(len(self), len(self) + len(keys), dtype=np.int32)
        self.starts = np.concatenate([self.starts, ends])
        order = np.argsort(keys)
        keys, entries = keys[order], entries[order]
        at = np.searchsorted(self.keys, keys)
        self.keys, self.entries = np.insert(self.keys, at, keys), np.insert(self.entries, at, entries)


class Encoder:
    """ids of whole texts; one object per Python worker and tokenizer file."""

    _made: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        self.memo = Memo()
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: model.encode(texts, num_threads=1)
            pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
            prefixed = model.encode("a", out_type=str)[0].startswith("▁") and model.encode("a  b ", out_type=str) != model.encode("a b", out_type=str)
            self.cut = self._by_runs if prefixed and not any(re.search("[^▁]▁", p) for p in pieces) else None
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; idle threads would keep memory
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.encode = lambda texts: [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)]
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            self.cut = self._by_spaces if _cuts_at_space(spec) else None
            self.special = [t["content"].lower() for t in spec.get("added_tokens", [])]
            self.lowers = any(n.get("type") == "Lowercase" for n in (spec.get("normalizer") or {}).get("normalizers", []))

    def _by_spaces(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Cut at spaces and line feeds and, if the tokenizer lowers case itself, between an ASCII letter and a mark that starts a pre-token of its own; there a text with a special token's string keeps to spaces."""
        if self.lowers:
            low = pc.ascii_lower(texts)
            finer = pc.replace_substring_regex(low, r"([a-z])([.,%&#$*!|;:?])", r"\1 \2")
            for s in self.special:
                finer = pc.if_else(pc.match_substring(low, s), texts, finer)
            texts = finer
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        return parts.flatten(), np.diff(parts.offsets.to_numpy())

    @staticmethod
    def _by_runs(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Cut at a space that follows neither a space nor the model's own space sign, never at the start."""
        odd = pc.or_(pc.match_substring(texts, "  "), pc.or_(pc.match_substring(texts, "▁"), pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " "))))
        if not pc.any(odd).as_py():
            parts = pc.split_pattern(texts, " ")
            return parts.flatten(), np.diff(parts.offsets.to_numpy())
        lists = [re.split(r"(?s)(?<=[^ ▁]) (?=.)", t) if o else t.split(" ") for t, o in zip(texts.to_pylist(), odd.to_pylist(), strict=True)]
        return pa.array([x for parts in lists for x in parts], pa.large_string()), np.array([len(x) for x in lists], np.int64)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each text); a null text is empty."""
        texts = _own(texts)
        if not len(texts):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        if self.cut is None:
            lists = self.encode(texts.to_pylist())
            return np.array([i for x in lists for i in x], np.uint32), np.array([len(x) for x in lists], np.int64)
        segments, per_text = self.cut(texts)
        coded = segments.dictionary_encode()
        starts, sizes = self._segments(coded.dictionary)
        index = coded.indices.to_numpy()
        n = sizes[index].astype(np.int64)
        return self.memo.ids[ragged(starts[index], n)], self._per_text(n, per_text)

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text, without putting the ids together."""
        texts = _own(texts)
        if not len(texts):
            return np.empty(0, np.int64)
        if self.cut is None:
            return np.array([len(x) for x in self.encode(texts.to_pylist())], np.int64)
        segments, per_text = self.cut(texts)
        coded = segments.dictionary_encode()
        return self._per_text(self._segments(coded.dictionary)[1][coded.indices.to_numpy()], per_text)

    @staticmethod
    def _per_text(n: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        before = np.concatenate([[0], np.cumsum(n)])
        ends = np.cumsum(per_text)
        return before[ends] - before[ends - per_text]

    def _segments(self, segments: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(start, size) in the memo's ids of each distinct segment; new ones go to the library."""
        if len(self.memo) > MEMO:
            self.memo = Memo()
        _, offsets, data = segments.buffers()
        ends = np.frombuffer(offsets, np.int64)[segments.offset : segments.offset + len(segments) + 1]
        keys = span_hashes(np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8), ends[:-1], ends[1:])
        new = np.flatnonzero(self.memo.find(keys) < 0)
        if len(new):
            lists = []
            for at in range(0, len(new), 20_000):
                lists += self.encode(segments.take(pa.array(new[at : at + 20_000])).to_pylist())
            self.memo.add(keys[new], lists)
        entry = self.memo.find(keys)
        starts = self.memo.starts[entry]
        return starts, self.memo.starts[entry + 1] - starts


keeps("tokens", Encoder._made.clear)
