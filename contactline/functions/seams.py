"""What the texts of nested elements, put one after the other, can hold addresses in, in linear size.

An address and its spellings consist of certain characters only; any other one (a break) ends them. A
blank between two plain characters, neither of them a dot, an "@" or a bracket, ends them too (a cut).
What lies between two such places is a word here, and words hold addresses on their own but for one
thing: the first "[at]" of a stretch takes all that follows up to the next "@" or break, so that a later
"[at]" there stays as it is.

So the text of a nested element has nothing new, except where it meets what stands before it: the word
over the seam, the word with its first "[at]", and the word with its first "@". These are taken, each
with an "[at]" before it if one is in force there, and the last word is carried on to the next seam.
"""

from __future__ import annotations

import re
import sys

from pyspark import cloudpickle

# Letters that count as some of A-Z in any case, as in the address pattern.
_CASE = "ſKİı"
_RUN = rf"A-Za-z0-9._%+\-\s\]\[()@{_CASE}"
_BREAK = re.compile(rf"[^{_RUN}]")
_LAST_BREAK = re.compile(rf"[^{_RUN}](?=[{_RUN}]*\Z)")
_PLAIN = r"[^\s.@\[\]()]"
_CUT = re.compile(rf"(?<={_PLAIN})\s+(?={_PLAIN})")
_AT = re.compile(
    rf"(?<=[A-Za-z0-9._%+\-{_CASE}])\s*(?:\[\s*at\s*\]|\(\s*at\s*\))(?=[A-Za-z0-9._%+\-\s\[\]()])", re.I)

#: An "[at]" that is in force, and no address.
_TAKEN = "a [at] b "
APART = " | "
#: A word of more characters is taken to end where a seam is. Texts without a break and without two
#: plain words next to each other over so many characters are not prose, and addresses are shorter.
LONGEST_WORD = 4_000


def _last_cut(text: str, low: int = 0, top: int | None = None) -> int:
    """End of the last cut of a text between ``low`` and ``top``. Without one the word begins at ``low``,
    or it is too long and ends at ``top``."""
    top = len(text) if top is None else top
    step = 64
    while True:
        begin, found = max(low, top - step), -1
        for m in _CUT.finditer(text, begin, top):
            found = m.end()
        if found > low:
            return found
        if begin == low:
            return low
        if step > LONGEST_WORD:
            return top
        step *= 4


def _taken(text: str, top: int) -> bool:
    """Whether an ``[at]`` before ``top`` is in force there."""
    return _AT.search(text, text.rfind("@", 0, top) + 1, top) is not None


def _word_at(text: str, place: int, low: int) -> tuple[int, int]:
    """Begin and end of the word that holds a place."""
    most = min(len(text), place + LONGEST_WORD)
    after = _CUT.search(text, place, most)
    return _last_cut(text, low, place), after.end() if after else most


def _carried(text: str) -> str:
    """The last word of a text, with what is in force before it."""
    at = _last_cut(text)
    return (_TAKEN if _taken(text, at) else "") + text[at:]


def _new_words(text: str, seam: int) -> list[str]:
    """Words of a stretch that may hold other addresses than without what stands before the seam."""
    cut = _CUT.search(text, seam, seam + LONGEST_WORD)
    end = cut.end() if cut else min(len(text), seam + LONGEST_WORD)
    words = [text[:end]]
    first = text.find("@", seam)
    if 0 <= first < end:
        return words
    taken = _taken(text, end)
    stop = first if first >= 0 else len(text)
    if not taken:
        mark = _AT.search(text, end, stop + 1)
        if mark:
            a, b = _word_at(text, mark.start(), end)
            words.append(text[a:b])
            if a <= first < b:
                return words
            taken = True
    if first >= 0:
        a, b = _word_at(text, first, end)
        words.append((_TAKEN if taken else "") + text[a:b])
    return words


def address_text(nodes: list[str], ranges: list[list[int]]) -> str:
    """A text with the addresses of ``" ".join`` of all ranges of the nodes, each a text of its own.
    Ranges stand in the order in which they begin, and lie in each other or apart."""
    # Of each node its first and last break; the next node with one, and the one before.
    first = [m.start() if (m := _BREAK.search(t)) else -1 for t in nodes]
    last = [_LAST_BREAK.search(t).start() if f >= 0 else -1 for t, f in zip(nodes, first, strict=True)]
    following, before = [len(nodes)] * (len(nodes) + 1), [-1] * (len(nodes) + 1)
    for i in reversed(range(len(nodes))):
        following[i] = i if first[i] >= 0 else following[i + 1]
    for i in range(len(nodes)):
        before[i + 1] = i if first[i] >= 0 else before[i]
    out: list[str] = []
    carried, outer = "", 0
    for k, (a, b) in enumerate(ranges):
        lead = carried + " " if k else ""
        if k == 0 or a >= outer:
            outer = b
            text = lead + " ".join(nodes[a:b])
            tail = _LAST_BREAK.search(text)
            low = tail.start() if tail else 0
            end = _last_cut(text, low)
            out.append(text[: end + 1] if tail and end == low else text[:end])
            carried = _carried(text[low:]) if tail else _carried(text)
            continue
        i = following[a]
        if i >= b:  # nothing ends the word before
            text = lead + " ".join(nodes[a:b])
            end = _last_cut(text)
            if end:
                out += _new_words(text[:end], min(len(lead), end))
            carried = _carried(text)
            continue
        text = lead + " ".join([*nodes[a:i], nodes[i][: first[i] + 1]])
        out += _new_words(text, len(lead))
        i = before[b]
        carried = _carried(" ".join([nodes[i][last[i] :], *nodes[i + 1 : b]]))
    out.append(carried)
    return APART.join(w for w in dict.fromkeys(out) if w)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
