"""Vectorised structural index over a batch of JSON texts (numpy, no per-character Python).

The batch is one byte buffer. Bitmaps of quotes, brackets and delimiters are taken from it, nesting
depth is a prefix sum over the brackets outside strings, and every token gets its enclosing container
by a search over (record, depth, position). Grammar rules are checked on neighbouring tokens, so a
record counts as complete JSON only if all of it obeys them.
"""

from __future__ import annotations

import json
import re

import numpy as np

QUOTE, BACKSLASH, COMMA, COLON = 34, 92, 44, 58
OBJ, END_OBJ, ARR, END_ARR = 123, 125, 91, 93
_NUMBER = re.compile(rb"-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][-+]?[0-9]+)?|true|false|null")
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 13, 32]] = True
_STRUCT = np.zeros(256, bool)
_STRUCT[[COMMA, COLON, OBJ, END_OBJ, ARR, END_ARR]] = True
_ESCAPES = np.zeros(256, bool)
_ESCAPES[list(b'"\\/bfnrtu')] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True


class JsonIndex:
    """Tokens of all records: ``pos``/``end`` byte span, ``rec``, ``kind`` (byte, 'S' or 'P'), ``cont`` enclosing token or -1."""

    S, P = ord("S"), ord("P")

    def __init__(self, texts: list[bytes]):
        self.raw = b"\n".join(texts) + b"\n"
        buf = self.buf = np.frombuffer(self.raw, np.uint8)
        n = len(texts)
        lens = np.fromiter((len(t) for t in texts), np.int64, n)
        starts = np.concatenate(([0], np.cumsum(lens + 1)[:-1])) if n else np.zeros(0, np.int64)
        bad = np.zeros(n, bool)

        bs = np.flatnonzero(buf == BACKSLASH)
        escaped = np.zeros(len(buf) + 1, bool)
        if bs.size:
            first = np.flatnonzero(np.concatenate(([True], np.diff(bs) != 1)))
            length = np.diff(np.concatenate((first, [bs.size])))
            odd = length % 2 == 1
            escaped[bs[first][odd] + length[odd]] = True
        quotes = np.flatnonzero(buf == QUOTE)
        quotes = quotes[~escaped[quotes]]
        rq = np.searchsorted(starts, quotes, "right") - 1
        count = np.bincount(rq, minlength=n)
        bad |= count % 2 == 1
        ordinal = np.arange(quotes.size) - np.concatenate(([0], np.cumsum(count)[:-1]))[rq] if n else quotes
        opening = ordinal % 2 == 0
        opens, closes = quotes[opening], quotes[~opening]
        edge = np.zeros(len(buf) + 1, np.int8)
        edge[opens] += 1
        edge[closes] -= 1
        dangling = np.flatnonzero(count % 2 == 1)
        edge[starts[dangling] + lens[dangling]] -= 1
        inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)  # from an opening quote up to before its closing one

        def blame(where: np.ndarray) -> None:
            if where.size:
                bad[np.searchsorted(starts, where, "right") - 1] = True

        blame(np.flatnonzero(inside & (buf < 32)))
        esc = np.flatnonzero(escaped[:-1])
        blame(esc[~_ESCAPES[buf[esc]] | ~inside[esc]])
        u = esc[buf[esc] == ord("u")]
        for k in range(1, 5):
            blame(u[~_HEX[buf[np.minimum(u + k, len(buf) - 1)]]])

        outside = ~inside
        outside[closes] = False
        struct = outside & _STRUCT[buf]
        prim = outside & ~struct & ~_SPACE[buf] & (buf != QUOTE)
        before = np.concatenate(([False], prim[:-1]))
        after = np.concatenate((prim[1:], [False]))
        p_start, p_end = np.flatnonzero(prim & ~before), np.flatnonzero(prim & ~after) + 1
        is_token = struct.copy()
        is_token[opens] = True
        is_token[p_start] = True
        pos = self.pos = np.flatnonzero(is_token)
        kind = self.kind = buf[pos].copy()
        is_p = prim[pos]
        kind[is_p] = self.P
        is_s = ~is_p & (kind == QUOTE)
        kind[is_s] = self.S
        end = self.end = pos + 1
        full = np.full(opens.size, len(buf), np.int64)
        if closes.size:
            nxt = np.searchsorted(closes, opens, "right")
            full[nxt < closes.size] = closes[nxt[nxt < closes.size]]
        end[is_s] = full
        end[is_p] = p_end
        rec = self.rec = np.searchsorted(starts, pos, "right") - 1

        texts_p = [self.raw[a:b] for a, b in zip(pos[is_p].tolist(), p_end.tolist())]
        wrong = {t for t in set(texts_p) if not _NUMBER.fullmatch(t)}
        if wrong:
            bad[rec[is_p][np.fromiter((t in wrong for t in texts_p), bool, len(texts_p))]] = True

        op, cl = (kind == OBJ) | (kind == ARR), (kind == END_OBJ) | (kind == END_ARR)
        step = op.astype(np.int64) - cl
        run = np.cumsum(step)
        first = np.searchsorted(rec, np.arange(n))
        base = np.concatenate(([0], run))[first]
        level = run - base[rec] - op
        size = np.searchsorted(rec, np.arange(n), "right") - first
        bad |= size == 0
        bad |= np.concatenate(([0], run))[first + size] != base
        bad[rec[level < 0]] = True
        level = np.maximum(level, 0)
        wide, far = int(level.max(initial=0)) + 2, len(buf) + 1
        key = (rec * wide + level + 1) * far + pos  # a container's own level, shifted by one
        own = np.flatnonzero(op)
        order = np.argsort(key[own], kind="stable")
        ranked = key[own][order]
        look = np.where(cl, key, key - far)
        at = np.searchsorted(ranked, look, "left") - 1
        cont = np.where(at >= 0, own[order][np.maximum(at, 0)] if own.size else -1, -1)
        same = (cont >= 0) & (rec[np.maximum(cont, 0)] == rec) & (level[np.maximum(cont, 0)] == level - ~cl)
        cont = self.cont = np.where(same, cont, -1)

        prev = np.concatenate(([0], kind[:-1]))
        fresh = np.zeros(pos.size, bool)
        fresh[first[size > 0]] = True
        prev[fresh] = 0
        ck = np.where(cont >= 0, kind[np.maximum(cont, 0)], 0)
        is_key = self.is_key = is_s & (ck == OBJ) & ((prev == OBJ) | (prev == COMMA))
        prev_key = np.concatenate(([False], is_key[:-1])) & ~fresh
        value = self.value = op | is_p | (is_s & ~is_key)
        closed = is_p | cl | (is_s & ~is_key)
        prev_closed = np.concatenate(([False], closed[:-1])) & ~fresh
        fine = np.select(
            [ck == 0, kind == COLON, kind == COMMA, kind == END_OBJ, kind == END_ARR, is_key, ck == OBJ],
            [fresh & value, prev_key, prev_closed, (ck == OBJ) & (prev_closed | (prev == OBJ)), (ck == ARR) & (prev_closed | (prev == ARR)), True, prev == COLON],
            (prev == ARR) | (prev == COMMA),
        )
        bad[rec[~fine]] = True
        self.ok = ~bad
        keyed = value & (prev == COLON)
        self.key_of = np.where(keyed, np.arange(pos.size) - 2, -1)  # the token that names this value
        self.only_string = np.zeros(n, bool)
        one = np.flatnonzero((size == 1) & self.ok)
        self.only_string[one] = kind[first[one]] == self.S

    def text(self, token: int) -> str | None:
        """The value of a string or scalar token; null is None."""
        if self.kind[token] == self.S:
            raw = self.raw[self.pos[token] + 1 : self.end[token]]
            return json.loads(b'"' + raw + b'"') if b"\\" in raw else raw.decode("utf-8", "replace")
        raw = self.raw[self.pos[token] : self.end[token]]
        return None if raw == b"null" else raw.decode()

    def named(self, name: str) -> np.ndarray:
        """Value tokens of complete records that stand under this key."""
        have = np.flatnonzero(self.key_of >= 0)
        have = have[self.ok[self.rec[have]]]
        k = self.key_of[have]
        raw = name.encode()
        hit = self.end[k] - self.pos[k] - 1 == len(raw)
        have, k = have[hit], k[hit]
        for j, byte in enumerate(raw, 1):
            hit = self.buf[self.pos[k] + j] == byte
            have, k = have[hit], k[hit]
        return have


def decoded(text: str) -> bytes:
    """A payload as bytes, without byte-order marks and blanks around it."""
    return text.strip("﻿ \t\r\n").encode("utf-8", "surrogatepass")
