"""Spelling variants: the vocabulary's acceptor, composed with a one-edit transducer and with itself."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import stored, text_or_empty

LETTERS = re.compile("[a-zÀ-ÿ]+")
#: Code points of a word, and its occurrences, at least.
SHORTEST, RAREST = 5, 3
#: A form occurs this many times as often as the word.
TIMES = 2
#: Words of one initial state that are taken as they are; larger sets are divided further.
BLOCK_WORDS = 20_000
#: Distinct words a task counts before it hands them on.
HELD = 300_000
#: One run in so many loses a letter, in the registered query.
EVERY = 97

Member = tuple[str, str, int]  # free part, word, occurrences


class Acceptor:
    """Minimal acyclic acceptor of words given in order: states with equal endings are one state."""

    def __init__(self, words: Iterable[str]):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        known: dict[tuple, int] = {}
        path: list[tuple[dict[str, int], list[bool]]] = [({}, [False])]
        before = ""

        def close(down_to: int) -> None:
            while len(path) > down_to + 1:
                arcs, final = path.pop()
                path[-1][0][before[len(path) - 1]] = self._state(known, arcs, final[0])

        for word in words:
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            close(shared)
            path += [({}, [False]) for _ in word[shared:]]
            path[-1][1][0] = True
            before = word
        close(0)
        self.start = self._state(known, path[0][0], path[0][1][0])

    def _state(self, known: dict[tuple, int], arcs: dict[str, int], final: bool) -> int:
        key = (final, *arcs.items())
        if key not in known:
            known[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final)
        return known[key]

    def _common(self, p: int, q: int) -> Iterator[str]:
        """The endings that both states accept."""
        stack = [("", p, q)]
        while stack:
            ending, p, q = stack.pop()
            letters = [ending]
            while True:
                both = [c for c in self.arcs[p] if c in self.arcs[q]]
                ends = self.final[p] and self.final[q]
                if ends or len(both) != 1:
                    break
                letters.append(both[0])
                p, q = self.arcs[p][both[0]], self.arcs[q][both[0]]
            ending = "".join(letters)
            if ends:
                yield ending
            stack += [(ending + c, self.arcs[p][c], self.arcs[q][c]) for c in both]

    def one_edit_pairs(self) -> Iterator[tuple[str, str]]:
        """The accepted pairs of the composition: (word, word with one letter replaced or left out), each once.

        Before its edit the transducer copies, so both sides stand in one state; after
        it, it copies again, and both go on with their common endings. Of equal letters
        in a row the last one is left out.
        """
        stack = [("", self.start)]
        while stack:
            prefix, state = stack.pop()
            letters = [prefix]
            # A state with one arc that ends no word has no edit of its own.
            while len(self.arcs[state]) == 1 and not self.final[state]:
                ((c, state),) = self.arcs[state].items()
                letters.append(c)
            prefix, arcs = "".join(letters), list(self.arcs[state].items())
            for i, (a, p) in enumerate(arcs):
                for b, q in arcs[i + 1 :]:
                    yield from ((prefix + a + ending, prefix + b + ending) for ending in self._common(p, q))
                yield from ((prefix + a + ending, prefix + ending) for ending in self._common(p, state) if ending[:1] != a)
                stack.append((prefix + a, p))


def near_words(members: list[Member], free: int, after: str) -> Iterator[tuple[int, int]]:
    """Pairs of members (by place) that differ by one edit inside their free parts.

    ``free`` is the length of the longer words' free parts, those of the shorter ones have a
    letter less; ``after`` is the letter that follows in all of them.
    """
    members_of = {part: i for i, (part, _, _) in enumerate(members)}
    parts = sorted(members_of)
    skip = 0  # what all share in front is never edited
    while parts[0][skip : skip + 1] and parts[0][skip : skip + 1] == parts[-1][skip : skip + 1]:
        skip += 1
    front = parts[0][:skip]
    for a, b in Acceptor(p[skip:] for p in parts).one_edit_pairs():
        if len(a) + skip != free:
            continue  # two of the shorter words: a block of their own length has them
        # Left out at the end, before an equal letter: the pair belongs to the block that edits there.
        if len(b) < len(a) and after and a[-1] == after and a[:-1] == b:
            continue
        yield members_of[front + a], members_of[front + b]


def _with_parts(words: DataFrame) -> DataFrame:
    """Every word in the blocks that its pairs can meet in: by length of the longer word and place of the edit.

    A pair of length (m, m) or (m, m - 1) is edited either in the front half of the longer
    word, and shares the rest, or in the back half, and shares the front. Columns: size (m),
    low, high (places that may be edited), word, n.
    """
    roles = "explode(array(struct(0 AS less), struct(1 AS less))) AS role"
    sized = words.selectExpr("word", "n", roles).selectExpr("word", "n", "role.less AS less", "length(word) + role.less AS size")
    halves = "explode(array(struct(0 AS low, size DIV 2 AS high), struct(size DIV 2 AS low, size AS high))) AS half"
    return sized.selectExpr("*", halves).selectExpr("word", "n", "less", "size", "half.low AS low", "half.high AS high")


def _keyed(parts: DataFrame) -> DataFrame:
    """The block of each row: all that its words share outside the places that may be edited."""
    return parts.selectExpr(
        "word",
        "n",
        "less",
        "size",
        "low",
        "high",
        "concat_ws(':', size, low, high, left(word, low), substring(word, high - less + 1)) AS block",
    )


def blocks(words: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The vocabulary by initial state: words that are alike outside an interval, inside which they may be edited.

    A block of too many words is divided: the edit lies in either half of the interval,
    and the words share the other half. It ends at one letter, with as many words as
    there are letters and one more, so that no block is large and no pair is lost.
    """
    open_, done = stored(_keyed(_with_parts(words))), None
    while True:
        sized = open_.join(open_.groupBy("block").agg(F.count("*").alias("members")).where("members > 1"), "block")
        small = sized.where((F.col("members") <= block_words) | (F.col("high") - F.col("low") <= 1))
        done = small if done is None else done.unionByName(small)
        large = sized.where((F.col("members") > block_words) & (F.col("high") - F.col("low") > 1))
        if large.isEmpty():
            return done.drop("members")
        middle = "explode(array(struct(low, (low + high) DIV 2 AS high), struct((low + high) DIV 2 AS low, high))) AS half"
        halved = large.selectExpr("word", "n", "less", "size", middle).selectExpr("word", "n", "less", "size", "half.low AS low", "half.high AS high")
        open_ = stored(_keyed(halved))


def _near_in_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walks over rows in order of block; of each word it hands on how many are near, and the commonest."""
    rows: list[tuple] = []
    found: dict[str, tuple[int, int, str]] = {}  # word: near words, minus the occurrences of the commonest, that one

    def settle() -> None:
        if all(r[3] for r in rows):
            return  # without a longer word no pair belongs here
        _, low, high, *_ = rows[0]
        after = next(word[high : high + 1] for _, _, _, less, word, _ in rows if not less)
        members = [(word[low : high - less], word, n) for _, _, _, less, word, n in rows]
        for i, j in near_words(members, high - low, after):
            for (_, word, _), (_, other, n) in ((members[i], members[j]), (members[j], members[i])):
                count, *best = found.get(word, (0, 0, ""))
                found[word] = (count + 1, *min((tuple(best), (-n, other)) if count else ((-n, other),)))

    def frame() -> pd.DataFrame:
        out = pd.DataFrame([(w, c, -n, f) for w, (c, n, f) in found.items()], columns=["word", "near", "form_n", "form"])
        found.clear()
        return out

    for b in batches:
        for row in zip(b["block"], b["low"].tolist(), b["high"].tolist(), b["less"].tolist(), b["word"], b["n"].tolist()):
            if rows and rows[0][0] != row[0]:
                settle()
                rows = []
                if len(found) > HELD:
                    yield frame()
            rows.append(row)
    settle()
    yield frame()


def near_counts(words: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """word, n_near, form_n, form (its near word of most occurrences, ties by code points) of words with near ones."""
    dealt = blocks(words, block_words).repartition("block").sortWithinPartitions("block")
    rows = dealt.select("block", "low", "high", "less", "word", "n")
    part = rows.mapInPandas(_near_in_blocks, "word string, near long, form_n long, form string")
    whole = part.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("n"), "form")).alias("best"))
    return whole.select("word", "n_near", (-F.col("best.n")).alias("form_n"), F.col("best.form").alias("form"))


def variants(words: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row of (word, n), one row per word.

    Words of under ``SHORTEST`` code points and null words are left out. ``form`` is the
    near word of most occurrences if these are ``TIMES`` the word's own, ``root`` the
    last one reached from form to form: each step doubles the occurrences, so a chain
    has fewer links than a bigint has bits, and is halved in every round.
    """
    words = stored(words.where(F.length("word") >= SHORTEST).select("word", F.col("n").cast("long").alias("n")))
    near = stored(words.join(near_counts(words, block_words), "word", "left"))
    taken = F.col("form_n") >= TIMES * F.col("n")
    named = near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *[F.when(taken, F.col(c)).alias(c) for c in ("form_n", "form")])
    steps = named.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        steps = stored(steps)
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = stored(steps.join(ahead, "root", "left"))
        steps = joined.select("word", F.coalesce("next", "root").alias("root"))
        if joined.where("next IS NOT NULL").isEmpty():
            break
    return named.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _plain(run: str, doc_id: str) -> str:
    return run


def slipped(run: str, doc_id: str) -> str:
    """The run without one letter where the hash says so: the input of the registered query."""
    h = zlib.crc32(f"{doc_id}:{run}".encode("utf-8", "surrogatepass"))
    at = h % len(run)
    return run[:at] + run[at + 1 :] if h % EVERY == 0 else run


def vocabulary(docs: DataFrame, written=_plain) -> DataFrame:
    """word, n: letter runs of the whole texts, A-Z in lower case, that are long and common enough.

    ``written`` may change a run, given its document's id. Null and empty texts have no words,
    a null id reads as the empty text, repeated rows count each, other columns are not read.
    Every task adds up its own words before they are shuffled, so a word's share does not matter.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()

        def frame() -> pd.DataFrame:
            out = pd.DataFrame(list(held.items()), columns=["word", "n"])
            held.clear()
            return out

        for b in batches:
            for doc_id, text in zip(b["id"], b["text"]):
                lower = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # bytes: only A-Z change
                for run, n in Counter(LETTERS.findall(lower)).items():
                    word = written(run, doc_id)
                    if len(word) >= SHORTEST:
                        held[word] += n
                if len(held) > HELD:
                    yield frame()
        yield frame()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), text_or_empty().alias("text"))
    return rows.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= RAREST)


def spelling_variants(docs: DataFrame) -> DataFrame:
    """``variants`` of the documents' words, some of which lose a letter first."""
    return variants(vocabulary(docs, slipped))
