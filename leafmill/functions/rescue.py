"""What of a block that mixes noise and body is body: measures of blocks, kinds of lines, cleaning and tests of what is rescued.

Patterns and limits are fixed values. Texts are collapsed to one line first.
"""

from __future__ import annotations

from leafmill.functions import text as T
from leafmill.functions.dual import E, all_of, any_of, count, extract_all, matches, replace, split, t, x
from leafmill.functions.merging import bound

METRIC = r"\b\d+(?:\.\d+)?\s*%\s+(?:reduction|improvement|accuracy|relative|speedup|energy|savings|loss|gain)\b"
OPENERS = (
    r"\b(?:In this work|In this paper|This paper|We present|We propose|We introduce|We evaluate|We show|Our method|Our design|The proposed|Evaluation results|Experimental results|Furthermore|However|Compared to|To support|Existing|Recent|Large language|Quantization)\b"
)
TRAILER = r"\b(?:Our code is available|Code is available|Source code is available|CCS Concepts|Keywords?|ACM Reference Format|Permission to make|This work is licensed)\b"
MAIL = r"[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
GROUPED_MAIL = r"\{[^}]{2,180}\}\s*@\s*[A-Z0-9.-]+\.[A-Z]{2,}"
PLACES = r"university|institute|college|department|laboratory|labs|school|technologies|corporation|china|usa|canada|germany|france|japan|korea"
MARKER = r"\b(?:ACM Reference Format|CCS Concepts|Keywords?|Permission to make|This work is licensed|Copyright|ISBN|DOI)\b"
CONNECTIVES = r"^(?:Furthermore|However|These|This|The|Our|It also|Evaluation|Experimental|Compared|Consequently)\b"
SUBJECTS = r"\b(?:we|our|the|this|these|model|method|design|results?|evaluation|accuracy|performance|forecasting|quantization|training|framework)\b"
LEAST_BLOCK, LEAST_CLEAN, LEAST_TEXT, SEARCH_FROM, CANDIDATE = 120, 80, 70, 0.22, 260


def _i(pattern: str) -> str:
    return f"(?i){pattern}"


def is_noisy_block(c: E, page: E) -> E:
    """E-mails, three institutions on the first two pages, or a publisher's marker."""
    return any_of(matches(c, _i(MAIL)), t("(<p> <= 2 AND <n> >= 3)", p=page, n=count(c, _i(rf"\b(?:{PLACES})\b"))), matches(c, _i(MARKER)))


def is_metric(c: E) -> E:
    return matches(c, _i(METRIC))


def is_code_notice(c: E) -> E:
    return matches(c, _i(r"^(?:Our code|Code|Source code)\s+(?:is|are)\s+available\b"))


def is_sentence(c: E) -> E:
    """70 characters or more with a sentence mark and 30 letters, 20 for one with a measured result."""
    return t("(length(<c>) >= 70 AND <mark> AND <n> >= CASE WHEN <metric> THEN 20 ELSE 30 END)", c=c, mark=matches(c, "[.!?。！？]"), n=count(c, r"\p{L}"), metric=is_metric(c))


def is_link(c: E) -> E:
    """A URL in under 260 characters, with at most twelve other words or more than 0.35 of the characters in URLs."""
    url = _i(T.URL)
    rest = t("trim(<r>)", r=replace(replace(c, url, " "), r"[^\p{L}]+", " "))
    return t("(<u> > 0 AND length(<c>) < 260 AND (<w> <= 12 OR length(<c>) - length(<r>) > 0.35 * length(<c>)))", c=c, u=count(c, url), w=count(rest, r"\S+"), r=replace(c, url, ""))


def is_noise_line(c: E, page: E) -> E:
    places = t("(<p> <= 2 AND <n> >= 2 AND NOT <mark>)", p=page, n=count(c, _i(rf"\b(?:{PLACES}|berkeley|rutgers)\b")), mark=matches(c, "[.!?。！？]"))
    return any_of(t("(<c> = '')", c=c), T.is_publication_metadata(c), matches(c, _i(TRAILER)), is_code_notice(c), is_link(c), matches(c, _i(MAIL)), matches(c, _i(GROUPED_MAIL)), places)


def line_kinds(c: E, page: E) -> dict[str, E]:
    """noise; body wherever it stands after noise; body only as the next line of one that is. What is neither ends a segment."""
    sentence, metric = is_sentence(c), is_metric(c)
    starts = all_of(any_of(matches(c, _i(METRIC)), matches(c, _i(OPENERS))), sentence)
    told = all_of(sentence, matches(c, _i(SUBJECTS)))
    goes_on = t("CASE WHEN <low> THEN length(<c>) >= 24 ELSE <word> AND length(<c>) >= 35 END", c=c, low=matches(c, r"^[a-z0-9,;:()\[\]\-–—]"), word=matches(c, _i(CONNECTIVES)))
    return {
        "noise": is_noise_line(c, page),
        "body": t("(NOT <code> AND CASE WHEN <metric> THEN length(<c>) >= 45 ELSE <starts> OR <told> END)", c=c, code=is_code_notice(c), metric=metric, starts=starts, told=told),
        "goes_on": t("(NOT <code> AND NOT <metric> AND <on>)", code=is_code_notice(c), metric=metric, on=goes_on),
    }


def cleaned(c: E) -> E:
    """Without what follows a publisher's notice, metadata, links and keyword lists."""
    cut = replace(T.collapse(c), _i(TRAILER + ".*$"), "")
    return T.collapse(replace(replace(T.strip_metadata(cut), _i(r"\s+(?:https?://|www\.)\S+"), " "), _i(r"\b(?:CCS Concepts|Keywords?)\s*[:：].*$"), " "))


def is_useful(c: E) -> E:
    """c is cleaned: 70 characters, ten words, 30 letters, a sentence mark, no e-mail, few links; no garbage or metadata."""
    links = t("(length(<c>) - length(<r>) < 0.16 * length(<c>))", c=c, r=replace(c, _i(T.URL), ""))
    return all_of(
        t(f"(length(<c>) >= {LEAST_TEXT})", c=c), t("(<n> >= 10)", n=count(c, r"\S+")), t("(<n> >= 30)", n=count(c, r"\p{L}")), matches(c, "[.!?。！？]"), t("(NOT <m>)", m=matches(c, _i(MAIL))), links,
        t("(NOT <g>)", g=T.is_extraction_garbage(c)), t("(NOT <m>)", m=T.is_publication_metadata(c)),
    )


def places_of(c: E, pattern: str) -> E:
    """Places (from 0) at which a pattern's matches begin: the parts between them and the matches themselves, added up."""
    found, between = extract_all(c, pattern), split(c, pattern)
    s = f"transform({found.s}, (m, i) -> aggregate(slice({between.s}, 1, i + 1), 0, (a, v) -> a + length(v)) + aggregate(slice({found.s}, 1, i), 0, (a, v) -> a + length(v)))"
    d = f"list_transform({found.d}, lambda m, i: list_sum(list_transform(list_slice({between.d}, 1, i), lambda v: length(v))) + coalesce(list_sum(list_transform(list_slice({found.d}, 1, i - 1), lambda v: length(v))), 0))"
    return E(s, d)


def mail_end(c: E) -> E:
    """Where the last e-mail address of a text ends; 0 without one."""
    parts = split(c, _i(MAIL))
    tail = E(f"element_at({parts.s}, -1)", f"{parts.d}[-1]")
    return t("CASE WHEN <m> THEN length(<c>) - length(<tail>) ELSE 0 END", c=c, m=matches(c, _i(MAIL)), tail=tail)


def body_start(clean: E, search: E) -> E:
    """The first place of clean, from search on, at which a body sentence opens that is useful once cleaned; null if there is none.

    The character before search only tells whether a word begins there: a letter stands for it.
    """
    before = t("CASE WHEN <s> > 0 AND <w> THEN 'x' ELSE ' ' END", s=search, w=matches(t("substring(<c>, CAST(<s> AS INT), 1)", c=clean, s=search), "[A-Za-z0-9_]"))
    rest = t("concat(<b>, substring(<c>, CAST(<s> AS INT) + 1))", b=before, c=clean, s=search)
    tail = x("tail")
    every = [places_of(tail, _i(p)) for p in (METRIC, OPENERS)]
    both = E(f"array_sort(array_distinct(concat({every[0].s}, {every[1].s})))", f"list_sort(list_distinct({every[0].d} || {every[1].d}))")
    candidate = t(f"substring(tail, CAST(place AS INT) + 1, {CANDIDATE})")
    good = bound(T.collapse(candidate), "cand", all_of(is_sentence(x("cand")), t("(NOT <c>)", c=is_code_notice(x("cand")))))
    useful = bound(cleaned(x("substring(tail, CAST(place AS INT) + 1)")), "body", is_useful(x("body")))
    first = E(f"get(filter({both.s}, place -> {good.s} AND {useful.s}), 0)", f"list_filter({both.d}, lambda place: {good.d} AND {useful.d})[1]")
    return t("(<s> + <f> - 1)", s=search, f=bound(rest, "tail", first))
