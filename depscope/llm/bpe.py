"""Byte-level BPE as a streaming transducer with bounded lookahead, and its inverse.

Encoding takes text in chunks and gives tokens once nothing that may follow can change them.
Words end at boundaries of the split pattern; a word is stable when the pattern's next few
characters are known. Inside a word of any length a token is stable once the sufficient lookahead
of the merge list lies behind it. That lookahead is computed from the merges: apply them in rank
order to two texts that share a prefix. Where their tokens first differ only moves left, and only when a
merge (u, v) joins the last common token u with a v that is there in one text alone; it then moves
by the length of u. Such a v starts with the u of the step before, so the longest chain of merges
of rising rank in which each u opens the next v bounds the whole move. Tokens that end further
left than that are final. Memory is the chunk, one window of a word and a bounded memo of words.

Decoding is a state machine from bytes to text that holds back at most three bytes of an unfinished
character; bytes that are no UTF-8 become U+FFFD.

Defined results: null text is empty and has no tokens; special tokens in a text are taken as such.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# Fixed value: the split pattern of byte-level BPE vocabularies, white space as the Unicode property.
_WHITE, _OTHER = r"\p{White_Space}", r"[^\p{White_Space}\p{L}\p{N}]"
_SPLIT = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?{_OTHER}+|{_WHITE}+(?!\P{{White_Space}})|{_WHITE}+")
_RUNS = tuple(regex.compile(p) for p in (r"\p{L}*", r"\p{N}*", _OTHER + "*"))
_SPACE_RUN = regex.compile(_WHITE + "*")
# The pattern never looks more than this many characters beyond the start of a match and past its end.
_AHEAD = 4
CHUNK, LONG_WORD, MEMO = 1 << 16, 256, 1 << 19
MAX_VOCABULARY_BYTES = 64 << 20


def _byte_symbols() -> dict[str, int]:
    """The printable stand-in of every byte in vocabulary files: printable ones stand for themselves, others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Merges and tokens of a byte-level vocabulary file, and what follows from them."""

    def __init__(self, text: str):
        data = json.loads(text)
        model, symbols = data["model"], _byte_symbols()
        if model["type"] != "BPE" or data.get("normalizer") or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE without a normalizer is supported")
        split = data.get("pre_tokenizer") or {}
        if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError("the pre-tokenizer must be byte level, with its pattern and without a prefix space")
        self.specials: dict[str, int] = {}
        for token in data.get("added_tokens") or ():
            if any(token[k] for k in ("lstrip", "rstrip", "single_word", "normalized")):
                raise ValueError(f"unsupported added token {token['content']}")
            self.specials[token["content"]] = token["id"]
        ids = model["vocab"]
        size = max([*ids.values(), *self.specials.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in ids.items():
            if token not in self.specials:
                self.bytes_of[i] = bytes(symbols[c] for c in token)
        for token, i in self.specials.items():
            self.bytes_of[i] = token.encode()
        self.byte_ids = [0] * 256
        for symbol, b in symbols.items():
            self.byte_ids[b] = ids[symbol]
        self.decimal = [str(i) for i in range(size)]
        self.ranks: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[ids[a], ids[b]] = rank
            self.merged.append(ids[a + b])
        self.lookahead = self._sufficient_lookahead()
        self.words = _Words(self)

    def _sufficient_lookahead(self) -> int:
        """Bytes behind a token after which no continuation changes it."""
        left: dict[int, int] = {}
        known = set(self.byte_ids)
        reach: dict[int, int] = {}
        most = 0
        for (u, v), rank in self.ranks.items():
            if u not in known or v not in known:
                raise ValueError("a merge uses a token that only later merges make")
            chain_ = 0
            opens: int | None = v
            while opens is not None:
                chain_ = max(chain_, reach.get(opens, 0))
                opens = left.get(opens)
            total = len(self.bytes_of[u]) + chain_
            reach[u] = max(reach.get(u, 0), total)
            most = max(most, total)
            token = self.merged[rank]
            if token in known:
                raise ValueError("two merges make one token")
            known.add(token)
            left[token] = u
        return most

    def merge_short(self, parts: list[int]) -> list[int]:
        """Merge lowest ranks first; for words of a few dozen bytes."""
        get, merged, none = self.ranks.get, self.merged, len(self.merged)
        found = [get(pair, none) for pair in zip(parts, parts[1:], strict=False)]
        while found:
            rank = min(found)
            if rank == none:
                break
            i = found.index(rank)
            parts[i] = merged[rank]
            del parts[i + 1], found[i]
            # Only the pairs beside the new token change.
            if i < len(found):
                found[i] = get((parts[i], parts[i + 1]), none)
            if i:
                found[i - 1] = get((parts[i - 1], parts[i]), none)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same with a heap and links, in n log n."""
        n, get = len(parts), self.ranks.get
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(rank, i, i + 1) for i in range(n - 1) if (rank := get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, j = heapq.heappop(heap)
            if not alive[i] or after[i] != j or j >= n or get((parts[i], parts[j])) != rank:
                continue
            parts[i], alive[j], after[i] = self.merged[rank], False, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (new := get((parts[i], parts[after[j]]))) is not None:
                    heapq.heappush(heap, (new, i, after[j]))
            if before[i] >= 0 and (new := get((parts[before[i]], parts[i]))) is not None:
                heapq.heappush(heap, (new, before[i], i))
        return [p for p, keep in zip(parts, alive, strict=True) if keep]


class _Words(dict):
    """Tokens of short words, remembered up to a bound."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> tuple[int, ...]:
        v, data = self.vocabulary, word.encode()
        if len(data) > LONG_WORD:
            run = _Run(v)
            return (*run.feed(data), *run.finish())
        if len(self) >= MEMO:
            self.clear()
        self[word] = tokens = tuple(v.merge_short(list(map(v.byte_ids.__getitem__, data))))
        return tokens


class _Run:
    """One word of any length, as a window of bytes."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.held = vocabulary, b""
        self.window = 4 * vocabulary.lookahead + LONG_WORD

    def _tokens(self, data: bytes) -> list[int]:
        return self.v.merge_long(list(map(self.v.byte_ids.__getitem__, data)))

    def feed(self, data: bytes) -> Iterator[int]:
        for start in range(0, len(data), self.window):
            self.held += data[start : start + self.window]
            stable, end = len(self.held) - self.v.lookahead, 0
            if len(self.held) < self.window:
                continue
            for token in self._tokens(self.held):
                size = len(self.v.bytes_of[token])
                if end + size > stable:
                    break
                end += size
                yield token
            self.held = self.held[end:]

    def finish(self) -> Iterator[int]:
        data, self.held = self.held, b""
        yield from self._tokens(data)


class Encoder:
    """Text in, stable tokens out: feed() any chunks, then finish()."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.held = ""
        self.run: _Run | None = None
        self.more = _SPACE_RUN
        self.specials = regex.compile("|".join(map(regex.escape, sorted(vocabulary.specials, key=len, reverse=True)))) if vocabulary.specials else None

    def feed(self, text: str) -> Iterable[int]:
        text, self.held = self.held + text, ""
        out: list[Iterable[int]] = []
        if self.specials:
            start = 0
            for m in self.specials.finditer(text):
                out += [self._segment(text[start : m.start()]), self._end_segment(), (self.v.specials[m[0]],)]
                start = m.end()
            text = text[start:] if start else text
            longest = max(map(len, self.v.specials)) - 1
            for k in range(min(longest, len(text)), 0, -1):
                if any(s.startswith(text[-k:]) for s in self.v.specials):
                    rest = text[-k:]
                    out.append(self._segment(text[:-k]))
                    self.held += rest
                    return chain.from_iterable(out)
        out.append(self._segment(text))
        return chain.from_iterable(out)

    def finish(self) -> Iterable[int]:
        return self._end_segment()

    def _segment(self, text: str) -> list[int]:
        """Tokens of a piece of text between special tokens, as far as they are stable."""
        text, self.held = self.held + text, ""
        out: list[int] = []
        if self.run:
            end = self.more.match(text).end()
            if self.more is _SPACE_RUN:
                # The last white space of a run may belong to what follows.
                stop = max(end - 1, 0)
                out += self.run.feed(text[:stop].encode())
                if end == len(text):
                    self.held = text[stop:]
                    return out
                text = text[stop:]
            else:
                out += self.run.feed(text[:end].encode())
                if end == len(text):
                    return out
                text = text[end:]
            out += self.run.finish()
            self.run = None
        words = _SPLIT.findall(text)
        size = kept = len(text)
        # Go back over matches that more text could change: the last, and those that start within reach of the end.
        n = len(words)
        while n and (n == len(words) or kept > size - _AHEAD):
            n -= 1
            kept -= len(words[n])
        out += chain.from_iterable(map(self.v.words.__getitem__, words[:n]))
        self.held = text[kept:]
        if n == len(words) - 1 and len(self.held) > CHUNK:
            out += self._start_run()
        return out

    def _start_run(self) -> Iterator[int]:
        """The held text is one unfinished word longer than a chunk: go on with it as a window."""
        word, self.held = self.held, ""
        self.run = _Run(self.v)
        if _SPACE_RUN.fullmatch(word):
            self.more, self.held = _SPACE_RUN, word[-1]
            return self.run.feed(word[:-1].encode())
        self.more = next(p for p in _RUNS if p.fullmatch(word, 1 if word[0] == " " else 0))
        return self.run.feed(word.encode())

    def _end_segment(self) -> list[int]:
        """Tokens of what is held, with nothing to follow."""
        text, self.held = self.held, ""
        if self.run:
            run, self.run = self.run, None
            # Held beside a run is only its last white space, or the start of what is no special token.
            if self.more is _SPACE_RUN:
                end = self.more.match(text).end()
                if end == len(text):
                    return [*run.feed(text.encode()), *run.finish()]
                stop = max(end - 1, 0)
            else:
                stop = self.more.match(text).end()
            return [*run.feed(text[:stop].encode()), *run.finish(), *chain.from_iterable(map(self.v.words.__getitem__, _SPLIT.findall(text[stop:])))]
        return list(chain.from_iterable(map(self.v.words.__getitem__, _SPLIT.findall(text))))


class Decoder:
    """Tokens in, text out; an unfinished character waits for its other bytes."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.held = vocabulary, b""

    def feed(self, tokens: Iterable[int]) -> str:
        data = self.held + b"".join(map(self.v.bytes_of.__getitem__, tokens))
        wait = 0
        for k in range(1, min(3, len(data)) + 1):
            byte = data[-k]
            if byte >= 0xC0:
                wait = k if k < (2 if byte < 0xE0 else 3 if byte < 0xF0 else 4) else 0
                break
            if byte < 0x80:
                break
        end = len(data) - wait
        self.held = data[end:]
        return data[:end].decode("utf-8", "replace")

    def finish(self) -> str:
        data, self.held = self.held, b""
        return data.decode("utf-8", "replace")


def encode(vocabulary: Vocabulary, text: str) -> Iterator[list[int]]:
    """The tokens of a text, chunk by chunk."""
    encoder = Encoder(vocabulary)
    for start in range(0, len(text), CHUNK):
        yield list(encoder.feed(text[start : start + CHUNK]))
    yield list(encoder.finish())


_loaded: dict[str, Vocabulary] = {}


def _vocabulary(text: str) -> Vocabulary:
    """Built once in each Python worker."""
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(text)
    return _loaded[key]


def read_vocabulary(path: str) -> str:
    """A vocabulary file's text, of checked size, to be sent to the executors."""
    with open(path, encoding="utf-8") as file:
        text = file.read(MAX_VOCABULARY_BYTES + 1)
    if len(text) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} characters")
    return text


def round_trip(docs: DataFrame, vocabulary_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of whole texts, encoded and decoded again."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(sent.value)
        decimal = v.decimal.__getitem__
        for batch in batches:
            counts, ids, back = [], [], []
            for value in batch.column("text"):
                n, told, said, decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder(v)
                for tokens in encode(v, value.as_py() or ""):
                    if tokens:
                        told.update((("," if n else "") + ",".join(map(decimal, tokens))).encode())
                        n += len(tokens)
                        said.update(decoder.feed(tokens).encode())
                said.update(decoder.finish().encode())
                counts.append(n)
                ids.append(told.hexdigest())
                back.append(said.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(work, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
