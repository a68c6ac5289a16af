"""Indel ratios: the longest common subsequence by bits, of one pair, or 64 places of many pairs in an operation."""

from __future__ import annotations

import numpy as np

#: Pairs that go together at most, words of the table of their letters, and characters between looks at what can still be reached.
PAIRS, TABLE_WORDS, LOOK = 1 << 16, 1 << 21, 16
#: Pairs for each 64 places of the band below which they are compared one by one.
FEW = 20
ONES, ONE = np.uint64((1 << 64) - 1), np.uint64(1)
#: The lowest k bits.
LOWEST = np.array([(1 << k) - 1 for k in range(65)], np.uint64)


def edits(a: int, b: int, least: float) -> int:
    """Most characters inserted or deleted between titles of these lengths."""
    return int((100 - least) * (a + b) / 100 + 1e-9)


def shifts(n: int, m: int, least: float) -> tuple[int, int]:
    """How far a segment of a title of n characters can be moved to the left and right in one of m >= n."""
    most = edits(n, m, least)
    return (most - (m - n)) // 2, (most + m - n) // 2


def places_of(a: str) -> dict[str, int]:
    """Bits of the places where each character stands."""
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    return places


def ratio(a: str, b: str, least: float) -> float:
    """Indel similarity in per cent: 2 LCS / (len a + len b); 0 if it is below `least`.

    The longest common subsequence is counted by bits of whole numbers, a character of the longer title at a
    time, along the band that `least` leaves; it ends as soon as what is left can't make up for what was missed.
    """
    if not a or not b:
        return 0.0
    if a == b:
        return 100.0
    if len(a) > len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if edits(n, m, least) < m - n:
        return 0.0
    left, right = shifts(n, m, least)
    places = places_of(a)
    needed = least * (n + m) / 200 - 1e-9
    full = row = (1 << n) - 1
    window = (1 << left + right + 1) - 1
    for j, ch in enumerate(b):
        # a[i] can stand for b[j] only if i is from j - right to j + left.
        near = window << j - right if j >= right else window >> right - j
        u = row & places.get(ch, 0) & near
        row = ((row + u) | (row - u)) & full
        # The rest of both is as long where `reach` places of a are behind: most can still be reached from there.
        reach = j + 1 - (m - n)
        if j & 31 == 31 and reach > 0 and reach - (row & (1 << reach) - 1).bit_count() + m - j - 1 < needed:
            return 0.0
    score = 200.0 * (n - row.bit_count()) / (n + m)
    return score if score >= least else 0.0


def points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


class Texts:
    """Shorter and longer texts, pairs of which are compared."""

    def __init__(self, short: list[str], long: list[str], least: float) -> None:
        self.least, self.short, self.long = least, short, long
        self.n, self.m = (np.array([len(t) for t in texts], np.int64) for texts in (short, long))
        self.starts = np.concatenate([[0], np.cumsum(self.n)])
        said = points(short)
        self.letters = np.unique(said)
        self.codes = np.searchsorted(self.letters, said) + 1
        # Characters of the longer texts by place, 0 for those that no shorter one has and beyond the end.
        said = points(long)
        at = np.minimum(np.searchsorted(self.letters, said), max(len(self.letters) - 1, 0))
        self.by_place = np.zeros((int(self.m.max(initial=0)), len(long)), np.uint16 if len(self.letters) < 1 << 16 else np.uint32)
        if len(self.letters):
            self.by_place[runs(self.m), np.repeat(np.arange(len(long)), self.m)] = np.where(self.letters[at] == said, at + 1, 0)

    def ratios(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """2 LCS / (n + m) in per cent of each pair of a shorter and a longer text, 0 if it is below `least`."""
        out = np.zeros(len(a))
        n, m = self.n[a], self.m[b]
        able = np.flatnonzero((n > 0) & (self.edits(n, m) >= m - n))
        n, m = n[able], m[able]
        # Pairs of near lengths go together, so that they share a narrow band.
        order = able[np.lexsort((a[able], (m - n) * 16 // n, np.log2(n) * 4 // 1))] if len(able) else able
        k = 0
        while k < len(order):
            now = order[k : k + PAIRS]
            while len(now) > 1 and len(np.unique(a[now])) * (len(self.letters) + 1) * (int(self.n[a[now]].max()) // 64 + 1) > TABLE_WORDS:
                now = now[: len(now) // 2]
            # Few long pairs don't make up for the calls of each 64 places of the band.
            few = len(now) < FEW * (int(self.edits(self.n[a[now]], self.m[b[now]]).max()) // 64 + 2)
            out[now] = [ratio(self.short[i], self.long[j], self.least) for i, j in zip(a[now].tolist(), b[now].tolist())] if few else self.compared(a[now], b[now])
            k += len(now)
        return out

    def edits(self, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        return ((100 - self.least) * (n + m) / 100 + 1e-9).astype(np.int64)

    def table(self, owners: np.ndarray) -> np.ndarray:
        """For each 64 places: bits of the places of each letter in each of the texts."""
        n, size = self.n[owners], len(self.letters) + 1
        place = runs(n)
        codes = self.codes[np.repeat(self.starts[owners], n) + place]
        found = np.zeros(((int(n.max()) + 63) // 64, len(owners) * size), np.uint64)
        # Each bit comes once, so that a sum is a union.
        np.add.at(found.reshape(-1), (place >> 6) * found.shape[1] + np.repeat(np.arange(len(owners)) * size, n) + codes, ONE << (place & 63).astype(np.uint64))
        return found

    def compared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ratios of pairs that go together.

        A bit of `rows` is 0 where the subsequence of the shorter text up to there is longer than up to the place before.
        The words that hold the band of all pairs are worked on: what has left it is counted, what is ahead is all ones.
        """
        owners, own = np.unique(a, return_inverse=True)
        table, out = self.table(owners), np.zeros(len(a))
        live, base = np.arange(len(a)), own * (len(self.letters) + 1)
        n, m = self.n[a], self.m[b]
        needed, spare = self.least * (n + m) / 200 - 1e-9, self.edits(n, m)
        left, right = int(((spare - (m - n)) // 2).max()), int(((spare + m - n) // 2).max())
        # Before this place even pairs without a common character could still be alike.
        rows, low, done, first = [], 0, np.zeros(len(a), np.int64), int((m - needed).min())

        def up_to(k: np.ndarray) -> np.ndarray:
            """Length of the subsequence with the first k places of the shorter text, k not before the band."""
            return done + sum((np.bitwise_count(~row & LOWEST[np.clip(k - 64 * w, 0, 64)]) for w, row in enumerate(rows, low)), np.zeros(len(k), np.int64))

        for j in range(int(m.max())):
            while low + len(rows) <= min((j + left) >> 6, len(table) - 1):
                rows.append(np.full(len(live), ONES))
            while rows and low < (j - right) >> 6:
                done += np.bitwise_count(~rows.pop(0))
                low += 1
            if not rows:
                break
            at = base + self.by_place[j].take(b)
            carry = None
            for w, row in enumerate(rows):
                used = table[low + w].take(at)
                used &= row
                total = row + used
                if w + 1 < len(rows):
                    over = total < row
                    if carry is not None:
                        total += carry
                        over |= total < carry
                    carry = over.astype(np.uint64)
                elif carry is not None:
                    total += carry
                row ^= used
                row |= total
            if j % LOOK == LOOK - 1 and j >= first:
                # The rest of both texts is as long at this place of the shorter one, where most can still be reached.
                reach = j + 1 - (m - n)
                going = (reach <= 0) | (up_to(reach) + np.maximum(m - j - 1, 0) >= needed)
                kept = int(np.count_nonzero(going))
                if kept == 0:
                    return out
                if kept < 0.8 * len(live):
                    live, base, b, n, m, needed, spare, done = (x[going] for x in (live, base, b, n, m, needed, spare, done))
                    rows = [row[going] for row in rows]
        score = 200.0 * (done + sum((np.bitwise_count(~row) for row in rows), np.zeros(len(live), np.int64))) / (n + m)
        out[live] = np.where(score >= self.least, score, 0.0)
        return out


def runs(n: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each n, one after the other."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
