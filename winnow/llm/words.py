"""Words of letters and digits: A-Z lower-cased, every ASCII character that is neither stands between words."""

from __future__ import annotations

from collections import Counter

#: What each byte of lower-cased UTF-8 becomes: letters, digits and all beyond ASCII stay, the rest is a space.
_KEPT = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Bytes of a text whose words are held at once.
RUN = 1 << 22


def word_counts(utf8: bytes) -> Counter:
    """How often each word occurs in the whole text, by its UTF-8 bytes."""
    out, a = Counter(), 0
    while a < len(utf8):
        b = len(utf8) if a + RUN >= len(utf8) else a + RUN
        run = utf8[a:b].lower().translate(_KEPT)
        if b < len(utf8):
            end = run.rfind(b" ")
            while end < 0:  # one word longer than a run
                b = min(len(utf8), b + RUN)
                run = utf8[a:b].lower().translate(_KEPT)
                end = len(run) if b == len(utf8) else run.rfind(b" ")
            run, b = run[:end], a + end
        out.update(run.split())
        a = max(b, a + 1)
    return out
