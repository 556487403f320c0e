"""SentencePiece BPE: encoding by vectorised merge rounds, and decoding.

Words of a batch of texts lie end to end in flat numpy arrays of symbols. A round finds the least
rank of a pair in each word, merges all its leftmost places at once and closes the gaps; a word
without a pair left is done. The ids are those of the sentencepiece library, which always merges
the leftmost of the best pairs: merging the places together is the same as one after the other,
but where a merge makes a pair that is as good or better; the places after that one wait a round.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.scratch import bounded_batches

SPACE = "▁"
#: No pair of these symbols is a piece.
NONE = np.int64(1 << 40)
#: Words kept between batches, and the longest kept; longer words are cut where no piece can span.
KEPT_WORDS, LONG_WORD = 400_000, 48
#: Symbols that are merged in the same rounds, to bound memory.
FLAT_SYMBOLS = 1 << 21


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("each_byte", _each_byte)


class Recent:
    """What is known of words lately met, in as many dictionaries as there are things to know: two generations of bounded size, the older one forgotten but for what is met again."""

    def __init__(self, things: int):
        self.now, self.before = ([{} for _ in range(things)] for _ in range(2))

    def known(self, words: set[str], learn: Callable[[list[str]], tuple[list, ...]]) -> list[dict]:
        """Return dictionaries that hold the words, learning new ones; words of unusual length are not kept."""
        if len(self.now[0]) > KEPT_WORDS // 2:
            self.now, self.before = [{} for _ in self.now], self.now
        new = words.difference(self.now[0])
        again = list(new.intersection(self.before[0]))
        for now, before in zip(self.now, self.before, strict=True):
            now.update(zip(again, map(before.__getitem__, again), strict=True))
        new.difference_update(again)
        short, long = [w for w in new if len(w) <= LONG_WORD], [w for w in new if len(w) > LONG_WORD]
        for now, values in zip(self.now, learn(short), strict=True):
            now.update(zip(short, values, strict=True))
        if not long:
            return self.now
        return [now | dict(zip(long, values, strict=True)) for now, values in zip(self.now, learn(long), strict=True)]


class PieceModel:
    """Pieces and merge ranks of a BPE model with byte fallback, identity normalisation and a space put in front.

    Other kinds of model are refused: their normalised probe or their pieces show them.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        library = SentencePieceProcessor(model_file=path)
        self.size, self.end = library.get_piece_size(), library.eos_id()
        probe = " a  ﬁ\téé "
        if library.normalize(probe) != SPACE + probe.replace(" ", SPACE) or library.id_to_piece(library.encode("\U000e0042"))[-1] != "<0x82>":
            raise ValueError(f"{path}: only models with identity normalisation and byte fallback are handled")
        special = [i for i in range(self.size) if library.is_control(i) or library.is_unknown(i) or library.is_byte(i)]
        pieces = {library.id_to_piece(i): i for i in range(self.size) if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i))}
        longer = [p for p in pieces if len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) for p in longer):
            raise ValueError(f"{path}: pieces that go on after a space are not handled")
        score = {p: library.get_score(i) for p, i in pieces.items()}
        scores = sorted({score[p] for p in longer}, reverse=True)
        rank_of = {s: n for n, s in enumerate(scores)}
        # Runs of spaces may share one score, the worst; they are merged last, by runs().
        self.run_ids = {len(p): pieces[p] for p in [SPACE, *longer] if p in pieces and not p.strip(SPACE)}
        tied = [p for p in longer if not p.strip(SPACE)]
        self.runs_last = bool(tied) and all(score[p] == scores[-1] for p in tied) and not any(p.startswith(SPACE * 2) and p.strip(SPACE) for p in longer)
        table = []
        for p in longer:
            if not (self.runs_last and not p.strip(SPACE)):
                table += [(pieces[p[:i]] * self.size + pieces[p[i:]], rank_of[score[p]], pieces[p]) for i in range(1, len(p)) if p[:i] in pieces and p[i:] in pieces]
        keys = np.array(sorted(table), dtype=np.int64).reshape(-1, 3)
        self.keys, self.ranks, self.merged = (np.append(keys[:, 0], 1 << 62), np.append(keys[:, 1], NONE), np.append(keys[:, 2], 0))
        # Symbols: the id of a character's piece, or size + code point where it has none.
        self.char = np.arange(0x110000, dtype=np.int64) + self.size
        for p, i in pieces.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        self.bytes = np.array([library.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int64)
        joints = {(ord(a), ord(b)) for p in longer for a, b in zip(p, p[1:], strict=False)}
        self.joints = np.array(sorted(a << 21 | b for a, b in joints), dtype=np.int64)
        inside = {c for p in longer for c in p}
        self.word = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if "\n" not in inside else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.surface = [library.id_to_piece(i).replace(SPACE, " ").encode() for i in range(self.size)]
        for i in special:
            self.surface[i] = bytes([int(library.id_to_piece(i)[3:5], 16)]) if library.is_byte(i) else b"" if library.is_control(i) else library.decode([i]).encode()
        self.silent = np.array([library.is_control(i) for i in range(self.size)])
        self.fronted = {i for p, i in pieces.items() if p.startswith(SPACE)}
        self.kept, self.texts = Recent(1), Recent(2)
        # After the last id, what parts words: neither sign is in what it parts, as 0xFF is in no UTF-8 text.
        self.numerals = [*map(str, range(self.size)), "\n"]
        self.surface.append(b"\xff")

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Return rank and merged id of pairs of symbols; rank NONE where they make no piece."""
        key = np.where((left < self.size) & (right < self.size), left * self.size + right, np.int64(-1))
        at = np.searchsorted(self.keys, key)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE), self.merged[at]

    def rounds(self, symbols: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge until no word has a pair left. symbols of all words in order, with the number of each one's word; returns both, merged."""
        done_symbols, done_words = [], []
        rank = np.full(len(symbols), NONE)
        merged = np.zeros(len(symbols), dtype=np.int64)

        def refresh(at: np.ndarray) -> None:
            at = at[(at >= 0) & (at < len(symbols) - 1)]
            at = at[words[at] == words[at + 1]]
            rank[at], merged[at] = self.pair(symbols[at], symbols[at + 1])

        refresh(np.arange(len(symbols) - 1))
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
            sizes = np.diff(np.r_[starts, len(symbols)])
            least = np.minimum.reduceat(rank, starts)
            ended = np.repeat(least == NONE, sizes)
            if ended.any():
                done_symbols.append(symbols[ended])
                done_words.append(words[ended])
                go = ~ended
                symbols, words, rank, merged = symbols[go], words[go], rank[go], merged[go]
                sizes, least = sizes[least < NONE], least[least < NONE]
                if not len(symbols):
                    break
            place = np.arange(len(symbols))
            best = rank == np.repeat(least, sizes)
            first = np.maximum.accumulate(np.where(best & ~np.r_[False, best[:-1]], place, 0))
            chosen = np.flatnonzero(best & ((place - first) % 2 == 0))
            chosen = self._undisturbed(symbols, words, merged, least, sizes, chosen)
            symbols[chosen] = merged[chosen]
            keep = np.ones(len(symbols), dtype=bool)
            keep[chosen + 1] = False
            now = np.cumsum(keep) - 1
            symbols, words, rank, merged = symbols[keep], words[keep], rank[keep], merged[keep]
            at = now[chosen]
            rank[at] = NONE
            before = at[at > 0] - 1
            rank[before[words[before] == words[before + 1]]] = NONE
            refresh(np.r_[at, before])
        if not done_words:
            return symbols, words
        symbols, words = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(words, kind="stable")
        return symbols[order], words[order]

    def _undisturbed(self, symbols, words, merged, least, sizes, chosen: np.ndarray) -> np.ndarray:
        """Of a word's places, keep those up to the first whose merge makes a pair as good or better: in turn, that pair would come next."""
        number = np.repeat(np.arange(len(sizes)), sizes)[chosen]
        several = np.bincount(number, minlength=len(sizes))[number] > 1
        if not several.any():
            return chosen
        some, of = chosen[several], number[several]
        new = merged[some]
        joined = np.r_[False, (some[1:] - some[:-1] == 2) & (of[1:] == of[:-1])]
        left = np.where(joined, np.r_[0, new[:-1]], symbols[some - 1])
        has_left = (some > 0) & (words[some - 1] == words[some])
        right_at = np.minimum(some + 2, len(symbols) - 1)
        has_right = (some + 2 < len(symbols)) & (words[right_at] == words[some])
        limit = least[of]
        worse = (has_left & (self.pair(left, new)[0] <= limit)) | (has_right & (self.pair(new, symbols[right_at])[0] <= limit))
        if not worse.any():
            return chosen
        stop = np.full(len(sizes), len(symbols))
        np.minimum.at(stop, of[worse], some[worse])
        return chosen[chosen <= stop[number]]

    @lru_cache(maxsize=4096)  # noqa: B019 (models are few and live as long as their process)
    def run(self, n: int) -> tuple[int, ...]:
        """Merge n spaces whose pieces all have one score: always the leftmost pair that is a piece."""
        done: list[int] = []
        parts: list[int] = []  # lengths; no two neighbours make a piece
        left = n
        while left:
            parts.append(1)
            left -= 1
            while len(parts) > 1 and parts[-2] + parts[-1] in self.run_ids:
                parts[-2:] = [parts[-2] + parts[-1]]
            while len(parts) > 2 and all(parts[0] + k not in self.run_ids for k in self.run_ids):
                done.append(parts.pop(0))
        return tuple(self.run_ids[k] for k in done + parts)

    def _cut(self, word: str) -> list[str]:
        """Cut a long word where no piece holds the two characters next to each other."""
        points = np.frombuffer(word.encode("utf-32-le"), dtype="<u4").astype(np.int64)
        joint = points[:-1] << 21 | points[1:]
        at = np.minimum(np.searchsorted(self.joints, joint), len(self.joints) - 1)
        ends = np.flatnonzero(self.joints[at] != joint) + 1
        bounds = [0, *ends.tolist(), len(word)]
        return [word[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def _merge_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Return the ids of all words, end to end, and where each one ends."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")
        numbers = np.repeat(np.arange(len(words)), [len(w) for w in words])
        symbols, numbers = self.rounds(self.char[points], numbers)
        if self.runs_last:
            symbols, numbers = self._merge_runs(symbols, numbers)
        unknown = symbols >= self.size
        if unknown.any():
            points = symbols - self.size
            times = np.where(unknown, 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF), 1)
            filled = self.bytes[np.frombuffer("".join(map(chr, points[unknown].tolist())).encode(), dtype=np.uint8)]
            symbols, numbers = np.repeat(symbols, times), np.repeat(numbers, times)
            symbols[np.repeat(unknown, times)] = filled
        return symbols, np.searchsorted(numbers, np.arange(1, len(words) + 1))

    def _merge_runs(self, symbols: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Put the pieces of runs in the place of runs of single spaces."""
        space = symbols == self.run_ids.get(1, -1)
        near = space & np.r_[False, space[:-1] & (numbers[1:] == numbers[:-1])]
        starts = np.flatnonzero(space & ~near)
        ends = np.flatnonzero(space & ~np.r_[near[1:], False]) + 1
        lengths = ends - starts
        keep = np.ones(len(symbols), dtype=bool)
        for start, length in zip(starts[lengths > 1].tolist(), lengths[lengths > 1].tolist(), strict=True):
            ids = self.run(length)
            symbols[start : start + len(ids)] = ids
            keep[start + len(ids) : start + length] = False
        return symbols[keep], numbers[keep]

    def _blocks(self, words: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        """Merge words in blocks of bounded size: words, ids end to end, ends."""
        block, size = [], 0
        for n, w in enumerate(words):
            block.append(w)
            size += len(w)
            if size > FLAT_SYMBOLS or n == len(words) - 1:
                yield block, *self._merge_words(block)
                block, size = [], 0

    def _ids(self, words: list[str]) -> tuple[list[list[int]]]:
        """Return the ids of words; long ones part by part."""
        parts = {w: self._cut(w) for w in words if len(w) > LONG_WORD}
        fresh: dict[str, list[int]] = {}
        for block, ids, ends in self._blocks(list(dict.fromkeys(p for w in words for p in parts.get(w, [w])))):
            flat, bounds = ids.tolist(), [0, *ends.tolist()]
            fresh.update(zip(block, [flat[a:b] for a, b in zip(bounds, bounds[1:], strict=False)], strict=True))
        return ([list(chain.from_iterable(map(fresh.__getitem__, parts[w]))) if w in parts else fresh[w] for w in words],)

    def split(self, texts: list[str]) -> list[list[str]]:
        """Cut texts into words that no piece goes beyond."""
        return [self.word.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Return the ids of each text, the end id last."""
        words = self.split(texts)
        (ids,) = self.kept.known(set(chain.from_iterable(words)), self._ids)
        return [np.array([*chain.from_iterable(map(ids.__getitem__, part)), self.end], dtype=np.int64) for part in words]

    def _said_and_shown(self, words: list[str]) -> tuple[list[str], list[str]]:
        """Return each word's ids as decimals, and the text that they decode to."""
        if any(len(w) > LONG_WORD for w in words):
            (ids,) = self._ids(words)
            return [" ".join(map(self.numerals.__getitem__, x)) for x in ids], [b"".join(map(self.surface.__getitem__, x)).decode() for x in ids]
        said, shown = [], []
        for _, ids, ends in self._blocks(words):
            marked = np.insert(ids, ends, self.size).tolist()
            said += " ".join(map(self.numerals.__getitem__, marked))[:-2].split(" \n ")
            shown += b"".join(map(self.surface.__getitem__, marked)).decode(errors="surrogateescape")[:-1].split("\udcff")
        return said, shown

    def encode_and_decode(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Return the number of each text's ids, the ids as decimals joined by spaces, and the text that they decode to.

        Bytes of a character never go beyond a word, so words are decoded one by one, each once.
        """
        words, out = self.split(texts), []
        said, shown = self.texts.known(set(chain.from_iterable(words)), self._said_and_shown)
        for part in words:
            ids = " ".join([*map(said.__getitem__, part), self.numerals[self.end]])
            out.append((ids.count(" ") + 1, ids, "".join(map(shown.__getitem__, part))[1:]))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Return the text of ids: control ids are silent, bytes that are no character become U+FFFD each, the space in front goes."""
        ids = np.asarray(ids, dtype=np.int64)
        parts = np.split(ids, np.flatnonzero(self.silent[ids])) if len(ids) else []  # bytes around a control id do not join
        text = "".join(b"".join([self.surface[i] for i in part.tolist()]).decode(errors="each_byte") for part in parts)
        said = ids[~self.silent[ids]] if len(ids) else ids
        return text[1:] if len(said) and said[0] in self.fronted else text


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_pieces(documents: DataFrame, text: str = "text", model: str | None = None) -> DataFrame:
    """Add ids, the whole text's token ids with the end id last. Null counts as empty; a column named ids is replaced."""
    path = model or default_model()
    bounded_batches(documents.sparkSession)
    rest = documents.drop("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = piece_model(path).encode([t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()])
            offsets = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
            flat = pa.array(np.concatenate([np.empty(0, dtype=np.int64), *ids]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, flat)], names=[*batch.schema.names, "ids"])

    schema = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in rest.schema.fields] + ["ids array<int>"])
    return rest.mapInArrow(run, schema)


def decode_pieces(tokens: DataFrame, ids: str = "ids", model: str | None = None) -> DataFrame:
    """Add text, decoded from ids; null where they are null. Ids out of the vocabulary are an error; a column named text is replaced."""
    path = model or default_model()
    rest = tokens.drop("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = piece_model(path)
            texts = [None if x is None else own.decode(x) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    schema = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in rest.schema.fields] + ["text string"])
    return rest.mapInArrow(run, schema)


def op12_piece_tokens(documents: DataFrame, model: str | None = None) -> DataFrame:
    """Encode every whole text and decode its ids: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A row per row of documents, whatever its doc_id (null and repeated ones too); a null or empty
    text is the end id alone and decodes to the empty text; other columns do not matter. Ids stay in
    the task that made them: nothing is shuffled.
    """
    path = model or default_model()
    bounded_batches(documents.sparkSession)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = piece_model(path)
            counts, ids_sha, text_sha = [], [], []
            for n, ids, text in own.encode_and_decode([t or "" for t in batch.column(1).to_pylist()]):
                counts.append(n)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                text_sha.append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.select(F.col("doc_id"), F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
