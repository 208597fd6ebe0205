"""One rule pattern, two regex dialects.

Rule patterns are written in PCRE spelling, as the source tool applies them:
byte-oriented (ASCII word characters), ``.`` stops at ``\\n`` only.

* Java (Spark): ``\\b`` is Unicode-aware and ``.`` also stops at ``\\r``,
  U+0085, U+2028, U+2029.  ``java()`` rewrites ``\\b`` to an ASCII lookaround
  and adds ``(?d)`` (UNIX_LINES) so ``.`` stops at ``\\n`` only.
* RE2 (DuckDB, used by the SQL oracle): already ASCII ``\\b`` and ``\\n``-only
  ``.``; ``re2()`` only adds flags.
"""

from __future__ import annotations

_W = "A-Za-z0-9_"
ASCII_BOUNDARY = f"(?:(?<=[{_W}])(?![{_W}])|(?<![{_W}])(?=[{_W}]))"


_WORD = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")
_QUANT = set("?*{")


def _literal_at(p: str, i: int):
    """(is_word, length) of a literal, unquantified character starting at p[i]; None if unknown."""
    if i >= len(p):
        return None
    if p[i] == "\\":
        if i + 1 < len(p) and not p[i + 1].isalnum():
            n = 2
            word = False
        else:
            return None
    elif p[i] in "()[]|.^$+*?{}":
        return None
    else:
        n = 1
        word = p[i] in _WORD
    if i + n < len(p) and p[i + n] in _QUANT:
        return None
    return word, n


def _group_alternatives(p: str, open_i: int):
    """Top-level alternatives of the group opening at p[open_i] and the index of its ')'."""
    depth, j = 0, open_i
    while j < len(p):
        if p[j] == "\\":
            j += 2
            continue
        if p[j] == "(":
            depth += 1
        elif p[j] == ")":
            depth -= 1
            if depth == 0:
                inner = p[open_i + 1:j]
                if inner.startswith("?:"):
                    inner = inner[2:]
                return _top_level_branches(inner), j
        j += 1
    return None, -1


def _starts_with_word(alt: str) -> bool:
    return bool(alt) and alt[0] in _WORD and not (len(alt) > 1 and alt[1] in _QUANT)


def _ends_with_word(alt: str) -> bool:
    return bool(alt) and alt[-1] in _WORD and not (len(alt) > 1 and alt[-2] == "\\")


def _boundary(p: str, i: int) -> str:
    """ASCII replacement for the \\b at p[i:i+2], as narrow as the neighbours allow."""
    nxt = _literal_at(p, i + 2)
    if nxt is not None:
        return f"(?<![{_W}])" if nxt[0] else f"(?<=[{_W}])"
    if i + 2 < len(p) and p[i + 2] == "(":
        alts, _ = _group_alternatives(p, i + 2)
        if alts and all(_starts_with_word(a) for a in alts):
            return f"(?<![{_W}])"
    if i >= 1 and p[i - 1] == ")":
        depth, j = 0, i - 1
        while j >= 0:
            if p[j] == ")" and (j == 0 or p[j - 1] != "\\"):
                depth += 1
            elif p[j] == "(" and (j == 0 or p[j - 1] != "\\"):
                depth -= 1
                if depth == 0:
                    break
            j -= 1
        alts, close = _group_alternatives(p, j) if j >= 0 else (None, -1)
        if alts and close == i - 1 and all(_ends_with_word(a) for a in alts):
            return f"(?![{_W}])"
    prev = None
    if i >= 1 and p[i - 1] in _WORD and not (i >= 2 and p[i - 2] == "\\"):
        prev = True
    elif i >= 2 and p[i - 2] == "\\" and not p[i - 1].isalnum():
        prev = False
    elif i >= 1 and p[i - 1] not in _WORD and p[i - 1] not in "()[]|.^$+*?{}\\":
        prev = False
    if prev is True:
        return f"(?![{_W}])"
    if prev is False:
        return f"(?=[{_W}])"
    return ASCII_BOUNDARY


def _word_run(p: str, i: int) -> str:
    """The literal word-character run starting at p[i] (its last character is dropped when a
    quantifier follows it)."""
    j = i
    while j < len(p) and p[j] in _WORD:
        j += 1
    if j < len(p) and p[j] in _QUANT:
        j -= 1
    return p[i:j] if j > i else ""


def java(pattern: str, ci: bool = False, dotall: bool = False) -> str:
    flags = "d" + ("i" if ci else "") + ("s" if dotall else "")
    out, i = [], 0
    while i < len(pattern):
        if pattern.startswith("\\b", i):
            run = _word_run(pattern, i + 2)
            if run:
                # literal first, then look back: lets the matcher scan for the literal
                out.append(f"{run}(?<![{_W}]{run})")
                i += 2 + len(run)
                continue
            out.append(_boundary(pattern, i))
            i += 2
        elif pattern[i] == "\\" and i + 1 < len(pattern):
            out.append(pattern[i:i + 2])
            i += 2
        else:
            out.append(pattern[i])
            i += 1
    return f"(?{flags})" + "".join(out)


def _top_level_branches(p: str) -> list[str]:
    parts, depth, cur, i = [], 0, [], 0
    while i < len(p):
        ch = p[i]
        if ch == "\\" and i + 1 < len(p):
            cur.append(p[i:i + 2])
            i += 2
            continue
        if ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
        if ch == "|" and depth == 0:
            parts.append("".join(cur))
            cur = []
        else:
            cur.append(ch)
        i += 1
    parts.append("".join(cur))
    return parts


def re2(pattern: str, ci: bool = False, dotall: bool = False) -> str:
    flags = ("i" if ci else "") + ("s" if dotall else "")
    return (f"(?{flags})" if flags else "") + pattern


def alternation(patterns: list[str]) -> str:
    """Any-of: one compiled pattern instead of N scans."""
    return "|".join(f"(?:{p})" for p in patterns)


def literal(text: str) -> str:
    """Escape a literal for use inside a pattern (same in both dialects)."""
    out = []
    for ch in text:
        out.append("\\" + ch if ch in r".^$*+?()[]{}|\/-" else ch)
    return "".join(out)


def sql_str(text: str) -> str:
    """DuckDB string literal (backslashes are literal in standard strings)."""
    return "'" + text.replace("'", "''") + "'"


def top_level_branches(pattern: str) -> list[str]:
    return _top_level_branches(pattern)


def expand_branch(branch: str, limit: int = 8):
    """The finite set of literal strings a simple branch can match, ignoring ``\\b`` (which only
    narrows): literal characters, escaped punctuation and single optional characters (``x?``,
    ``\\.?``).  Returns (strings, has_boundary) or None when the branch uses anything else."""
    outs, i, has_b = [""], 0, False
    while i < len(branch):
        ch = branch[i]
        if ch == "\\" and i + 1 < len(branch):
            nxt = branch[i + 1]
            if nxt == "b":
                has_b, i = True, i + 2
                continue
            if nxt.isalnum():
                return None
            lit, i = nxt, i + 2
        elif ch in "()[]|.^$+*?{}":
            return None
        else:
            lit, i = ch, i + 1
        if i < len(branch) and branch[i] == "?":
            outs = [o + lit for o in outs] + outs
            i += 1
        elif i < len(branch) and branch[i] in "*{+":
            return None
        else:
            outs = [o + lit for o in outs]
        if len(outs) > limit:
            return None
    return outs, has_b


def branch_runs(branch: str) -> list[str]:
    """Every literal run that each match of the branch must contain (outside groups and
    optional characters)."""
    runs, cur, depth, i = [], [], 0, 0

    def cut():
        if cur:
            runs.append("".join(cur))
        cur.clear()

    while i < len(branch):
        ch = branch[i]
        if ch == "\\" and i + 1 < len(branch):
            nxt = branch[i + 1]
            if nxt.isalnum():
                cut()
                i += 2
                continue
            lit, i = nxt, i + 2
        elif ch in "()[]|.^$+*?{}":
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "[":
                j = branch.find("]", i + 1)
                i = j if j > 0 else i
            cut()
            i += 1
            continue
        else:
            lit, i = ch, i + 1
        if depth > 0:
            continue
        if i < len(branch) and branch[i] in _QUANT:
            cut()
            continue
        cur.append(lit)
    cut()
    return runs
