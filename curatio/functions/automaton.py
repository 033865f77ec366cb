"""Many keywords searched at once in the texts of an Arrow batch.

The keywords form a trie whose goto table is one flat array (state, byte) -> state;
state 0 is dead, state 1 the root.  Texts lie end to end in one buffer.  A table over
two-byte starts leaves the few places where a keyword may begin; all of them step
through the goto table together, byte by byte, until none is alive.  Every place
starts at the root, so no failure links are needed, and the cost does not depend on
how long single texts are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: bytes of the buffer whose places step together
SLICE = 1 << 22


class Keywords:
    def __init__(self, keywords):
        words = [k.encode() for k in keywords]
        if not all(words):
            raise ValueError("a keyword is empty")
        rows, self.found = [np.zeros(256, np.int32), np.zeros(256, np.int32)], [-1, -1]
        self.starts = np.zeros(1 << 16, bool)
        for number, word in enumerate(words):
            state = 1
            for byte in word:
                if not rows[state][byte]:
                    rows[state][byte] = len(rows)
                    rows.append(np.zeros(256, np.int32))
                    self.found.append(-1)
                state = rows[state][byte]
            self.found[state] = number
            first = word[0] << 8
            if len(word) == 1:
                self.starts[first: first + 256] = True
            else:
                self.starts[first + word[1]] = True
        self.n, self.goto, self.found = len(words), np.concatenate(rows), np.array(self.found)

    def hits(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Number of different keywords in each text (``off``: the n + 1 bounds)."""
        n, seen = len(off) - 1, []
        for at in range(0, len(buf), SLICE):
            part = buf[at: at + SLICE + 1].astype(np.uint16)
            pair = part << 8
            pair[:-1] |= part[1:]
            place = np.flatnonzero(self.starts[pair[: SLICE if len(part) > SLICE else len(part)]]) + at
            text = np.searchsorted(off, place, side="right") - 1
            end, state = off[text + 1], np.ones(len(place), np.int32)
            while len(place):
                alive = place < end
                place, text, end, state = place[alive], text[alive], end[alive], state[alive]
                state = self.goto[state.astype(np.int64) * 256 + buf[place]]
                alive = state > 0
                place, text, end, state = place[alive] + 1, text[alive], end[alive], state[alive]
                number = self.found[state]
                whole = number >= 0
                seen.append(np.unique(text[whole] * self.n + number[whole]))
        keys = np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.int64)
        return np.bincount(keys // max(1, self.n), minlength=n)


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end and the n + 1 bounds; NULL counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset: texts.offset + len(texts) + 1]
    buf = np.frombuffer(data, np.uint8)[off[0]: off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]
