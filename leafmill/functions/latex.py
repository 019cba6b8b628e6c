"""LaTeX out of broken formula text: shard lines, bare expressions, letters of the mathematical alphabets.

Patterns are fixed values; the alphabets are ranges of code points.
"""

from __future__ import annotations

import re

from leafmill.functions.dual import E, _pattern, all_of, count, matches, t, x

#: (first, last, letter or digit that the first stands for).
ALPHABETS = [
    (0x1D400, 0x1D419, "A"), (0x1D41A, 0x1D433, "a"), (0x1D434, 0x1D44D, "A"), (0x1D44E, 0x1D467, "a"), (0x1D468, 0x1D481, "A"), (0x1D482, 0x1D49B, "a"), (0x1D5A0, 0x1D5B9, "A"), (0x1D5BA, 0x1D5D3, "a"),
    (0x1D7CE, 0x1D7D7, "0"),
]
SHARD = r"^[A-Za-z0-9\\{}()\[\],.:;=+\-*/^_<>\s≤≥≠≈∑∏∫√∞→←↔±×÷∂λμσγαβθΩΔ⋯…|]+$"
OPERATOR = r"[:=<>≤≥≠≈∑∏∫√∞→←↔±×÷∂]|\\[A-Za-z]+|\\[{}]|[{}^_]|⋯|…"
VARIABLE = r"[A-Za-z][A-Za-z0-9]*|[αβγδεθλμσΩΔ]"
PROSE = r"^[A-Za-z]{4,}(?:\s+[A-Za-z]{3,})+$"
TIGHT = r"\s*([=<>≤≥≠≈+\-*/→←↔±×÷])\s*"
#: Fixed names of Greek letters, functions and measures.
GREEK = [("θ𝜃𝛉𝝑", "theta"), ("α𝛼𝜶", "alpha"), ("β𝛽𝜷", "beta"), ("γ𝛾𝜸", "gamma"), ("σ𝜎𝝈", "sigma"), ("μ𝜇𝝁", "mu"), ("λ𝜆𝝀", "lambda"), ("η𝜂𝜼", "eta"), ("Ω𝛺𝜴", "Omega"), ("Δ𝛥𝜟", "Delta")]
FUNCTIONS, MEASURES, FORMATS, SUFFIXES = "log|exp|min|max|softmax|argmin|argmax", "WQL|MASE|CRPS|NLL|RMSE|MSE|QL", "FP|INT|MXFP|NVFP|SMX", r"elem|meta|scale|max|min|pow|idx|top\d?"
LEAST_SHARDS, SHARD_CHARS, SHORT_CHARS, SHORT_SHARE = 4, 80, 16, 0.75


def regroup(c: E, pattern: str, to: str) -> E:
    r"""Every match as `to`, in which \1 is a group and \\ a backslash."""
    p = _pattern(pattern)
    java = re.sub(r"(\\\\)|\\(\d)", lambda m: m[1] or f"${m[2]}", to)
    return E(f"regexp_replace({c.s}, r'{p.s}', r'{java}')", f"regexp_replace({c.d}, '{p.d}', '{to}', 'g')")


def trimmed(c: E) -> E:
    return regroup(c, r"^\s+|\s+$", "")


def plain_letters(c: E) -> E:
    """Letters and digits of the mathematical alphabets as those of ASCII."""
    pairs = [(chr(k), chr(ord(a) + k - first)) for first, last, a in ALPHABETS for k in range(first, last + 1)] + [("ℎ", "h")]
    return t(f"translate(<c>, '{''.join(a for a, _ in pairs)}', '{''.join(b for _, b in pairs)}')", c=c)


def is_shard(line: E) -> E:
    """1 to 80 characters of ASCII letters, digits, brackets and formula signs."""
    clean = trimmed(line)
    return all_of(t(f"length(<c>) BETWEEN 1 AND {SHARD_CHARS}", c=clean), matches(clean, SHARD))


def expression(c: E) -> E:
    """Shards in one line as a formula: no space round signs and brackets, a letter with an index behind it as a subscript."""
    out = regroup(plain_letters(c), r"\s+", " ")
    for pattern, to in (
        (r"\s*:\s*=\s*", ":="), (TIGHT, r"\1"), (r"\s*,\s*", ","), (r"\s*(\\[{}])\s*", r"\1"), (r"\s*([{}()\[\]])\s*", r"\1"),
        (r"\b([A-Za-z])\s+([0-9]+(?::[A-Za-z0-9]+)?|[A-Za-z])\b", r"\1_{\2}"), (r"\\\s+([A-Za-z{}])", r"\\\1"),
    ):
        out = regroup(out, pattern, to)
    return trimmed(out)


def formula_latex(c: E) -> E:
    """A formula's text as LaTeX: Greek letters, functions and measures by their names, indices as subscripts."""
    out = regroup(regroup(regroup(plain_letters(c), r"\s+", " "), "−", "-"), "ℓ", r"\\ell")
    for letters, name in GREEK:
        out = regroup(out, f"[{letters}]", rf"\\{name}")
    for pattern, to in (
        (rf"\b({FUNCTIONS})\b", r"\\\1"), (rf"\b({MEASURES})\b", r"\\mathrm{\1}"), (rf"\b({FORMATS})(\d+)\b", r"\\mathrm{\1\2}"), (rf"(?i)\b([A-Za-z])(?:_)?({SUFFIXES})\b", r"\1_{\\mathrm{\2}}"),
        (r"\bp(?:_?\{?\\theta\}?|\\theta)\b", r"p_{\\theta}"), (r"\b([A-Za-z])([A-Z]\s*[+\-]\s*[A-Za-z0-9]+(?:\s*[+\-]\s*[A-Za-z0-9]+)*)\b", r"\1_{\2}"),
        (r"\b([A-Za-z])(\d+(?::[A-Za-z0-9+\-]+)?(?:[+\-][A-Za-z0-9]+)*)\b", r"\1_{\2}"), (TIGHT, r"\1"), (r"\s*,\s*", ","), (r"\s+", " "),
    ):
        out = regroup(out, pattern, to)
    return trimmed(out)


def run_signs(clean: E) -> dict[str, E]:
    """Of a line of a run: what a broken formula is told by."""
    return {"short": t(f"(length(<c>) <= {SHORT_CHARS})", c=clean), "prose": matches(clean, PROSE)}


def is_broken(joined: E, n: str, n_short: str, n_prose: str) -> E:
    """A run of shards, joined: four at least, a formula sign and a variable, most of them short, at most one of prose."""
    return all_of(x(f"{n} >= {LEAST_SHARDS}"), t("(<n> > 0)", n=count(joined, OPERATOR)), t("(<n> > 0)", n=count(joined, VARIABLE)), x(f"{n_short} >= {SHORT_SHARE} * {n}"), x(f"{n_prose} <= 1"))
