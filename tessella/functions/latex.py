"""LaTeX formulas: normal form, and a plain text by which they can be searched."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.text import _c

# The signs that commands stand for, and the characters that have a raised form.
SIGNS = {
    "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "varepsilon": "ε", "zeta": "ζ", "eta": "η", "theta": "θ", "vartheta": "ϑ", "iota": "ι", "kappa": "κ", "lambda": "λ", "mu": "μ", "nu": "ν", "xi": "ξ", "pi": "π", "varpi": "ϖ", "rho": "ρ", "varrho": "ϱ", "sigma": "σ", "varsigma": "ς", "tau": "τ", "upsilon": "υ", "phi": "φ", "varphi": "φ", "chi": "χ", "psi": "ψ", "omega": "ω",
    "Gamma": "Γ", "Delta": "Δ", "Theta": "Θ", "Lambda": "Λ", "Xi": "Ξ", "Pi": "Π", "Sigma": "Σ", "Upsilon": "Υ", "Phi": "Φ", "Psi": "Ψ", "Omega": "Ω",
    "infty": "∞", "partial": "∂", "nabla": "∇", "forall": "∀", "exists": "∃", "nexists": "∄", "in": "∈", "notin": "∉", "ni": "∋", "subset": "⊂", "supset": "⊃", "subseteq": "⊆", "supseteq": "⊇", "cup": "∪", "cap": "∩", "emptyset": "∅",
    "rightarrow": "→", "leftarrow": "←", "to": "→", "Rightarrow": "⇒", "Leftarrow": "⇐", "leftrightarrow": "↔", "Leftrightarrow": "⇔", "uparrow": "↑", "downarrow": "↓",
    "times": "×", "div": "÷", "pm": "±", "mp": "∓", "cdot": "·", "cdots": "⋯", "ldots": "…", "dots": "…", "leq": "≤", "geq": "≥", "neq": "≠", "approx": "≈", "equiv": "≡", "sim": "∼", "simeq": "≃", "cong": "≅", "propto": "∝", "ll": "≪", "gg": "≫",
    "prime": "′", "sum": "∑", "prod": "∏", "int": "∫", "oint": "∮", "sqrt": "√", "angle": "∠", "perp": "⊥", "parallel": "∥", "Re": "ℜ", "Im": "ℑ", "aleph": "ℵ", "hbar": "ℏ", "ell": "ℓ", "neg": "¬", "therefore": "∴", "because": "∵",
}
SUPERSCRIPTS = ("0123456789-+n=()ijklm", "⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺ⁿ⁼⁽⁾ⁱʲᵏˡᵐ")
# Commands that only set a font or a size, by what becomes of them.
FONTS = {"mathbf", "boldsymbol", "mathrm", "mathit", "mathbb", "mathcal", "bm"}
BARE = {"wedge", "max", "min", "mathrm", "mathbf", "boldsymbol", "mathit", "text", "mbox", "rm", "bf", "it", "operatorname", "mathcal", "mathbb", "Big", "big", "left", "right"}
WRAPPERS = {"mathrm", "mathbf", "boldsymbol", "mathit", "mathbb", "mathcal", "text", "mbox", "rm", "bf", "it", "cal", "bb"}
TIGHT_FONTS = {"mathrm", "mathbb", "mathcal", "bm"}
PROSE = {"text", "mbox"}
_BY_LENGTH = sorted(SIGNS, key=len, reverse=True)


def scan(latex: str) -> list:
    """A formula as a list of pieces: commands with their backslash, blanks as one blank, other characters, groups as lists."""
    open_lists: list[list] = [[]]
    i = 0
    while i < len(latex):
        c, j = latex[i], i + 1
        if c == "\\":
            while j < len(latex) and latex[j].isascii() and latex[j].isalpha():
                j += 1
            open_lists[-1].append(latex[i : max(j, min(i + 2, len(latex)))])
            j = max(j, i + 2)
        elif c == "{":
            group: list = []
            open_lists[-1].append(group)
            open_lists.append(group)
        elif c == "}" and len(open_lists) > 1:
            open_lists.pop()
        elif c.isspace():
            if not open_lists[-1] or open_lists[-1][-1] != " ":
                open_lists[-1].append(" ")
        else:
            open_lists[-1].append(c)
        i = j
    while len(open_lists) > 1:  # a brace that nothing closes is a character
        group = open_lists.pop()
        open_lists[-1][-1:] = ["{", *group]
    return open_lists[0]


def _letter(piece) -> bool:
    return isinstance(piece, str) and len(piece) == 1 and piece.isascii() and piece.isalpha()


def _word(piece) -> bool:
    return isinstance(piece, str) and len(piece) == 1 and piece.isascii() and piece.isalnum()


def _ends(pieces: list) -> list:
    """Without blanks at both ends."""
    start, end = 0, len(pieces)
    while start < end and pieces[start] == " ":
        start += 1
    while end > start and pieces[end - 1] == " ":
        end -= 1
    return pieces[start:end]


def _has_prose(pieces: list) -> bool:
    return any(_has_prose(x) if isinstance(x, list) else x[1:] in PROSE for x in pieces)


def _tight(group: list) -> list:
    """A group after a font or a script mark: letters that recognition set apart come together."""
    if _has_prose(group):
        return group
    inner = _ends(group)
    return [x for i, x in enumerate(inner) if not (x == " " and _letter(inner[i - 1]) and i + 1 < len(inner) and _letter(inner[i + 1]))]


def _usual(pieces: list) -> list:
    """The pieces in their usual form, groups included."""
    out: list = []
    rest = [_usual(x) if isinstance(x, list) else x for x in pieces]
    i = 0
    while i < len(rest):
        x = rest[i]
        after = i + 1 + (rest[i + 1 : i + 2] == [" "])
        follows = rest[after] if after < len(rest) else None
        if x in ("^", "_"):
            close = out[-1:] == [" "] and (x == "^" or _word(out[-2] if len(out) > 1 else None))
            if close:
                out.pop()
            out.append(x)
            i = after if x == "^" or close or isinstance(follows, list) else i + 1
            if x == "^" and isinstance(follows, list) and _ends(follows) == ["\\wedge"]:
                out.append("T")  # a transpose that recognition read as a wedge, its own T included
                i = after + 1
                left = rest[i:]
                i += next((k + 1 for k, y in enumerate(left[:2]) if y == "T" and left[:k] in ([], [" "])), 0)
            elif isinstance(follows, list):
                out.append(_tight(follows))
                i = after + 1
            continue
        out.append(x)
        i += 1
        if isinstance(x, str) and x[0] == "\\" and x[1:] in FONTS:
            if isinstance(follows, list):
                out.append(_tight(follows))
                i = after + 1
            elif x[1:] in TIGHT_FONTS:
                i = after
    return out


def _written(pieces: list) -> str:
    return "".join(f"{{{_written(x)}}}" if isinstance(x, list) else x for x in pieces)


@F.pandas_udf(T.StringType())
def _normalised(latex: pd.Series) -> pd.Series:
    return latex.map(lambda x: _written(_ends(_usual(scan(x)))), na_action="ignore")


def normalise(latex: Column | str) -> Column:
    """Transposes, letters and blanks of a recognised formula in their usual form; null stays null."""
    return _normalised(_c(latex))


def _sign(command: str) -> str:
    """What a command reads as: whole names first, so that no short command eats the beginning of a longer one."""
    name = command[1:]
    if name in SIGNS or name in BARE:
        return SIGNS.get(name, name)
    known = next((s for s in _BY_LENGTH if name.startswith(s)), None)
    return SIGNS[known] + name[len(known) :] if known else command


def _plain(pieces: list) -> str:
    out = []
    for i, x in enumerate(pieces):
        if isinstance(x, list):
            before = next((p for p in reversed(pieces[:i]) if p != " "), None)
            wrapped = isinstance(before, str) and before[0] == "\\" and before[1:] in WRAPPERS
            nested = any(isinstance(y, list) for y in x) and not wrapped
            out.append(f"{{{_plain(x)}}}" if nested else _plain(x))
        elif x[0] == "\\" and len(x) > 1:
            k = i + 1 + (pieces[i + 1 : i + 2] == [" "])
            opens = x[1:] in WRAPPERS and k < len(pieces) and isinstance(pieces[k], list)
            out.append("" if opens else _sign(x))
        else:
            out.append(x)
    return "".join(out)


def _scripts(text: str) -> str:
    """Single superscripts raised, the mark of a subscript digit or equals sign dropped, no blank after one of a letter."""
    raised, out, i = dict(zip(*SUPERSCRIPTS)), [], 0
    while i < len(text):
        c = text[i]
        k = i + 1
        while c == "_" and k < len(text) and text[k] == " ":
            k += 1
        follows = text[k : k + 1]
        if c == "^" and follows in raised and (follows.isalnum()):
            out.append(raised[follows])
            i = k + 1
        elif c == "_" and (follows == "=" or (follows.isascii() and follows.isdigit())):
            i = k
        elif c == "_" and follows.isalnum():
            out.append("_")
            i = k
        else:
            out.append(c)
            i += 1
    return "".join(out)


def _digits_joined(text: str) -> str:
    """Blanks collapsed; none stays between digits, nor around a point between digits."""
    words, out = text.split(), ""
    for i, w in enumerate(words):
        follows = words[i + 1 : i + 2]
        point = w == "." and out[-1:].isdigit() and bool(follows) and follows[0][0].isdigit()
        number = w[0].isdigit() and (out[-1:].isdigit() or (words[i - 1] == "." and out[-2:-1].isdigit() and out.endswith(".")))
        out += w if not out or point or number else f" {w}"
    return out


@F.pandas_udf(T.StringType())
def _read(latex: pd.Series) -> pd.Series:
    return latex.map(lambda x: _digits_joined(_scripts(_plain(scan(x)))), na_action="ignore")


def to_text(latex: Column | str) -> Column:
    """Plain text: wrappers off, commands to signs, braces off, single superscripts raised, digits joined; null stays null."""
    return _read(_c(latex))
