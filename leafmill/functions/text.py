"""Text functions and predicates over a column, as dual expressions; `.col()` gives the Spark column.

All are built-in expressions: they stay inside generated code and are pushed through projections.
Word lists, thresholds and patterns below are fixed values.
"""

from __future__ import annotations

from leafmill.functions.dual import E, all_of, any_of, between, count, extract, extract_all, gated, matches, once, replace, t, x

KNOWN_HEADINGS = ["abstract", "introduction", "related work", "background", "method", "methods", "methodology", "experiments", "experiment", "results", "discussion", "conclusion", "references", "appendix"]
METRIC_WORDS = (
    r"architecture|scaling|factor|data\s+type|data|type|metadata|content|dataset|granularity|horizon|method|model|metric|mae|mse|rmse|mape|wql|smape|accuracy|precision|recall|f1|perplexity"
    r"|baseline|ours|chronos|kronos|m2xfp|nvfp|mxfp|smx|olive|tender|mant|bitmod|total|average|avg|cost|latency|throughput"
)
SENTENCE_END = ".!?。！？"
VENUES = (
    "AAAI|ACL|ASPLOS|ATC|CHI|COLING|CVPR|DAC|DATE|ECCV|EMNLP|EuroSys|FAST|HPCA|ICCV|ICDE|ICLR|ICML|IJCAI|ISCA|KDD|MICRO|MLSys|NAACL|NeurIPS|NIPS|NSDI|OSDI|PLDI|POPL"
    "|SIGCOMM|SIGGRAPH|SIGIR|SIGMOD|SOSP|UIST|USENIX|VLDB|WSDM|WWW"
)
MONTHS = "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
COUNTRIES = r"USA|U\.S\.A\.|US|United States|Canada|UK|China|Japan|Korea|Germany|France|Italy|Spain|Austria|Australia|Virtual|Online"
VENUE_DATE_PLACE = rf"(?i)\b(?:{VENUES})\s*[’\x27‘]?\d{{2,4}}\b\s*,\s*(?:{MONTHS})\b[^.!?。！？\n]{{0,42}}\b\d{{4}}\b\s*,\s*[^.!?。！？\n]{{2,90}}\b(?:{COUNTRIES})\b"
ARXIV_STAMP = rf"(?i)\s*arXiv:\d{{4}}\.\d{{4,5}}(?:v\d+)?(?:\s*\[[^\]]{{1,80}}\])?(?:\s+\d{{1,2}}\s+(?:{MONTHS})\s+\d{{4}})?\s*"
VENUE_HEADER = rf"(?i)(?:^(?:\d{{1,2}}(?:st|nd|rd|th)\s+)?(?:(?:ACM|IEEE|USENIX|AAAI|SIAM)\s+)?(?:International\s+)?(?:Conference|Symposium|Workshop)\b|^(?:{VENUES})\s*[’\x27‘]?\d{{2,4}}\b)"
TITLE_STOP_WORDS = ["a", "an", "and", "as", "for", "in", "of", "on", "the", "to", "with"]
URL = r"(?:https?://|www\.)\S+"


# -- normal forms ----------------------------------------------------------------------------------


#: Names of columns whose text is collapsed already.
COLLAPSED = {"clean", "whole", "body", "readable"}
#: Names that texts have for Spark alone, where they are collapsed already.
ONE_LINE = {"flat", "told"}


def collapse(c: E) -> E:
    """Runs of whitespace become one space; none at the ends."""
    if c.s in COLLAPSED:
        return c
    out = t("trim(<r>)", r=replace(c, r"\s+", " "))
    return E(c.s, out.d) if c.s in ONE_LINE else out


def paragraph(c: E, flat: E | None = None) -> E:
    """Without caption sentences, in one line. flat: for Spark, a column with c collapsed."""
    caption = r"(?:Figure|Fig\.|Table)\s+\d+[a-z]?\s*:[^.!?。！？]*(?:[.!?。！？]|$)"
    cut = lambda v: collapse(replace(replace(v, "(?i)^" + caption, " "), r"(?i)\s+" + caption, " "))
    return once(c, lambda v: gated(f"contains({v.s}, ':')", cut(v), flat or collapse(v)), "whole_text")


def heading_text(c: E) -> E:
    """Without numbering and closing colon or period."""
    return t("trim(<r>)", r=replace(replace(collapse(c), r"^\d+(?:\.\d+)*\.?\s+", ""), r"[:：.]+$", ""))


def letters_key(c: E) -> E:
    """Lower case, letters and digits only, one space between."""
    return t("trim(<r>)", r=replace(t("lower(<c>)", c=c), r"[^\p{L}\p{N}]+", " "))


def coverage_key(c: E) -> E:
    return replace(t("lower(<c>)", c=c), r"[^a-z0-9]+", "")


def dedupe_key(kind: E, page: E, c: E) -> E:
    return t("concat(<k>, ':', CAST(<p> AS STRING), ':', substring(<c>, 1, 220))", k=kind, p=page, c=letters_key(c))


def repeated_key(c: E) -> E:
    """Key of text that repeats over pages; empty for headings and for less than 6 or more than 160 characters."""

    def keyed(clean: E) -> E:
        key = t("trim(<r>)", r=replace(replace(t("lower(<c>)", c=clean), r"\b\d+\b", "#"), r"[^\p{L}\p{N}#]+", " "))
        return t("CASE WHEN <ok> AND NOT <h> THEN <key> ELSE '' END", ok=between(clean, 6, 160), h=is_heading(clean), key=key)

    return once(paragraph(c), keyed, "flat")


def reference_key(c: E) -> E:
    """figure, table and equation shortened; no spaces, dots and brackets."""
    out = t("lower(<c>)", c=c)
    for word, short in (("figure", "fig"), ("table", "tab"), ("equation", "eq")):
        out = replace(out, word, short)
    return replace(out, r"[\s.()]", "")


def query_text(c: E) -> E:
    return t("substring(lower(<c>), 1, 120)", c=collapse(c))


def truncate(c: E, limit: int, mark: str = "...") -> E:
    return t(f"CASE WHEN length(<c>) <= {limit} THEN <c> ELSE concat(trim(substring(<c>, 1, {limit - 1})), '{mark}') END", c=c)


def slug(c: E) -> E:
    return t("substring(<r>, 1, 80)", r=replace(replace(t("lower(<c>)", c=c), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""))


def join_fragments(a: E, b: E) -> E:
    """A word cut at a hyphen is joined if the next fragment begins in lower case; else one space."""
    return t("CASE WHEN <a> LIKE '%-' AND <low> THEN concat(substring(<a>, 1, length(<a>) - 1), <b>) ELSE trim(concat(<a>, ' ', <b>)) END", a=a, b=b, low=matches(b, "^[a-z]"))


def escape_xml(c: E) -> E:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = E(f"replace({c.s}, '{a}', '{b}')", f"replace({c.d}, '{a}', '{b}')")
    return c


def decode_xml(c: E) -> E:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        c = E(f"replace({c.s}, '{a}', '{b}')", f"replace({c.d}, '{a}', '{b}')")
    return c


def fingerprint(c: E, n: int = 24) -> E:
    return t(f"substring(sha1(<c>), 1, {n})", c=c)


def strip_metadata(c: E) -> E:
    """Without preprint stamps and venue-date-place strings; empty if what is left, at most 260 characters, is metadata; no dangling `such as`."""
    stripped = lambda v: gated(f"{v.s} rlike '[0-9]'", collapse(replace(replace(v, ARXIV_STAMP, " "), VENUE_DATE_PLACE, " ")), collapse(v))

    def judged(clean: E) -> E:
        rest = collapse(replace(clean, r"(?i)\b(?:such as|including|e\.g\.,?|for example)\s*$", ""))
        short = E(f"length({clean.s}) <= 260 AND {(m := is_publication_metadata(clean)).s}", t("<m> AND length(<c>) <= 260", m=m, c=clean).d)
        return t("CASE WHEN <short> THEN '' ELSE <r> END", short=short, r=rest)

    return once(c, lambda v: once(stripped(v), judged, "flat"), "whole_text")


def section_hint(c: E) -> E:
    """Title of 2 to 90 characters without its number; empty for placeholders."""
    title = t("trim(<r>)", r=replace(replace(paragraph(c), r"^\d+(?:\.\d+)*\.?\s+", ""), "[:：]+$", ""))
    return once(title, lambda v: t("CASE WHEN <ok> AND NOT <stop> THEN <c> ELSE '' END", c=v, ok=between(v, 2, 90), stop=matches(v, "(?i)^(?:正文|body|unknown|n/a|null|none)$")))


def comparable(c: E) -> E:
    """Lower case without spaces, common punctuation and quotes."""
    return replace(t("lower(<c>)", c=collapse(c)), r"[\s\-_:：.,，。()\[\]{}（）【】\x22\x27“”‘’]", "")


def title_tokens(c: E, key: E | None = None) -> E:
    stop = ", ".join(f"'{w}'" for w in TITLE_STOP_WORDS)
    key = key if key is not None else letters_key(c)
    return E(f"filter(split({key.s}, ' '), v -> length(v) >= 2 AND v NOT IN ({stop}))", f"list_filter(string_split({key.d}, ' '), lambda v: length(v) >= 2 AND v NOT IN ({stop}))")


def is_title_header(c: E, title: E, page: E, given: tuple[E, E, E, E] | None = None) -> E:
    """The document's title repeated at the head of a later page: equal or contained, or four tokens and 0.78 of all shared.

    given: columns with the letters_key of both and their title_tokens, where c and title are paragraphs already.
    """
    clean, name = (c, title) if given else (paragraph(c), paragraph(title))
    ka, kb, a, b = given or (letters_key(clean), letters_key(name), title_tokens(clean), title_tokens(name))
    shared = E(f"size(filter({a.s}, v -> array_contains({b.s}, v)))", f"len(list_filter({a.d}, lambda v: list_contains({b.d}, v)))")
    na, nb = size(a), size(b)
    return t(
        "(<p> > 1 AND <ok> AND <n> <> '' AND NOT <open> AND NOT (<end> AND NOT <mark>) AND <ka> <> '' AND <kb> <> '' AND (<ka> = <kb> OR (<na> >= 3 AND <nb> >= 4 AND "
        "((<na> >= 4 AND (contains(<kb>, <ka>) OR contains(<ka>, <kb>))) OR (<sh> >= 4 AND <sh> >= 0.78 * <na>)))))",
        p=page, ok=between(clean, 12, 180), n=name, end=matches(clean, "[.!?。！？]$"), mark=matches(name, "[?:：]$"), ka=ka, kb=kb, na=na, nb=nb, sh=shared,
        open=matches(clean, r"(?i)^(?:abstract|introduction|background|method|approach|evaluation|experiments?|results?|discussion|conclusion|appendix|references)\b"),
    )


# -- lists -----------------------------------------------------------------------------------------


def size(array: E) -> E:
    return E(f"CAST(size({array.s}) AS BIGINT)", f"CAST(len({array.d}) AS BIGINT)")


def first_by(array: E, key) -> E:
    """Items whose key (an expression of the item) no earlier item has."""
    v = key(x("v"))
    d = f"list_transform({array.d}, lambda v: {v.d})"
    # the array and its keys are each bound once: inside the filter they would be made again for every item
    once = f"transform(array(transform(a, v -> {v.s})), k -> filter(a, (v, i) -> array_position(k, k[i]) = i + 1))[0]"
    return E(f"transform(array({array.s}), a -> {once})[0]", f"list_filter({array.d}, lambda v, i: list_position({d}, {v.d}) = i)")


def _items(c: E, marks: str, clean, most: int) -> E:
    v = clean(x("v"))
    return E(
        f"filter(transform(split({c.s}, r'{marks}'), v -> {v.s}), v -> length(v) BETWEEN 1 AND {most})",
        f"list_filter(list_transform(regexp_split_to_array({c.d}, '{marks}'), lambda v: {v.d}), lambda v: length(v) BETWEEN 1 AND {most})",
    )


def keywords(c: E) -> E:
    """Items between commas, semicolons and line breaks, at most 80 characters, first spelling of each."""
    return first_by(_items(c, r"[,，;；、\n]", collapse, 80), lambda v: t("lower(<v>)", v=v))


def tags(c: E, most: int = 12) -> E:
    """Items between commas, hashes and line breaks, cut to 32 characters, first spelling of each, `most` at most."""
    cut = lambda v: t("substring(<v>, 1, 32)", v=collapse(replace(v, "^#+", "")))
    all_ = first_by(_items(c, r"[,，#\n]", cut, 32), lambda v: t("lower(<v>)", v=v))
    return E(f"slice({all_.s}, 1, {most})", f"list_slice({all_.d}, 1, {most})")


SYMBOL_STOP_WORDS = ["a", "an", "and", "are", "as", "at", "by", "for", "from", "in", "is", "it", "of", "on", "or", "the", "to", "with"]


def symbols(c: E) -> E:
    """Acronyms, names with sub- or superscripts and single letters between operators, at most 24 characters, no stop words; distinct and sorted."""
    # an operator between two letters ends one match and starts the next: each is written twice
    twice = E(f"regexp_replace({c.s}, r'([=+\\-*/^,()])', '$1$1')", f"regexp_replace({c.d}, '([=+\\-*/^,()])', '\\1\\1', 'g')")
    found = [
        extract_all(c, r"\b[A-Z][A-Z0-9]{1,14}\b"),
        extract_all(c, r"\b[A-Za-z][A-Za-z0-9]*(?:[_^][A-Za-z0-9{}]+)+\b"),
        extract_all(twice, r"(?:^|[=+\-*/^,(])\s*([A-Za-z])\s*(?:[=+\-*/^,)]|\z)", 1),
    ]
    clean = replace(x("v"), r"[.,;:()\[\]{}]+$", "")
    stop = ", ".join(f"'{w}'" for w in SYMBOL_STOP_WORDS)
    kept = f"length(v) BETWEEN 1 AND 24 AND lower(v) NOT IN ({stop})"
    return E(
        f"array_sort(array_distinct(filter(transform(concat({', '.join(f.s for f in found)}), v -> {clean.s}), v -> {kept})))",
        f"list_sort(list_distinct(list_filter(list_transform({' || '.join(f.d for f in found)}, lambda v: {clean.d}), lambda v: {kept})))",
    )


def reference_tokens(c: E, most: int = 8) -> E:
    """Figures and tables, then equations, then bracketed citations, first of each key."""
    found = [extract_all(c, p) for p in (r"(?i)\b(?:figure|fig\.|table|tab\.?)\s*\d+[a-z]?(?:\s*\([a-z]\))?", r"(?i)\b(?:eq\.?|equation)\s*\(?\d+[a-z]?\)?", r"\[[0-9,\s-]{1,32}\]")]
    one = collapse(x("v"))
    every = E(f"transform(concat({', '.join(f.s for f in found)}), v -> {one.s})", f"list_transform({' || '.join(f.d for f in found)}, lambda v: {one.d})")
    uniq = first_by(every, reference_key)
    return E(f"slice({uniq.s}, 1, {most})", f"list_slice({uniq.d}, 1, {most})")


def cue_kind(c: E) -> E:
    """Kind of artifact that a text speaks of without a number."""
    clean = collapse(c)
    figure = any_of(
        matches(clean, r"(?i)\b(?:figure|fig\.|diagram|chart|plot|visualization|illustration)\b"), matches(clean, r"(?i)\b(?:shown|illustrated|depicted|visualized)\s+(?:above|below|here)\b"), matches(clean, r"(?i)\b(?:above|below)\s+(?:shows|illustrates|depicts)\b"),
    )
    return t("CASE WHEN <e> THEN 'equation' WHEN <t> THEN 'table' WHEN <f> THEN 'figure' ELSE '' END", e=matches(clean, r"(?i)\b(?:equation|eq\.|formula|objective|loss function)\b"), t=matches(clean, r"(?i)\b(?:table|tabular)\b"), f=figure)


# -- measures --------------------------------------------------------------------------------------


def script_counts(c: E) -> dict[str, E]:
    return {
        "latin": count(c, "[A-Za-z]"), "han": count(c, r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]"), "kana": count(c, r"[\x{3040}-\x{30ff}]"),
        "hangul": count(c, r"[\x{ac00}-\x{d7af}]"), "digits": count(c, "[0-9]"),
    }


def token_estimate(chars: E) -> E:
    return t("CAST(ceil(greatest(<c>, 0) / 3.5) AS BIGINT)", c=chars)


def meaningful_chars(c: E) -> E:
    return t("CAST(length(<r>) AS BIGINT)", r=replace(c, r"[^\p{L}\p{N}]", ""))


def sentences(c: E) -> E:
    clean = collapse(c)
    spaced, bare = count(clean, r"[.!?。！？；;]\s+"), count(clean, "[.!?。！？；;]")
    return t("CASE WHEN <c> = '' THEN 0 WHEN <s> > 0 THEN <s> + 1 ELSE <b> + 1 END", c=clean, s=spaced, b=bare)


# -- predicates ------------------------------------------------------------------------------------


def is_heading(c: E) -> E:
    """3 to 90 characters; numbered with a capital, or a known title."""
    names = ", ".join(f"'{n}'" for n in KNOWN_HEADINGS)
    text = t("trim(<c>)", c=c)
    return all_of(between(text, 3, 90), any_of(matches(text, r"^\d+(?:\.\d+)*\.?\s+[A-Z][A-Za-z0-9_\s:-]+$"), t(f"lower(<c>) IN ({names})", c=text)))


def is_caption(c: E) -> E:
    return matches(c, r"(?i)^(?:figure|fig\.|table)\s+\d+[a-z]?\s*[:.]")


def is_references_title(c: E) -> E:
    title = once(heading_text(c), lambda v: all_of(between(v, 1, 90), matches(v, "(?i)^(?:references|bibliography|参考文献)$")))
    return E(f"({c.s} rlike '(?i)references|bibliography|参考文献' AND {title.s})", title.d)


def is_author_line(c: E, page: E) -> E:
    """Author or affiliation text, by e-mails, institution words and fixed phrases."""
    mails = count(c, r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}")
    return any_of(
        t("(<m> >= 2 AND (length(<c>) < 520 OR (<p> <= 2 AND length(<c>) < 1400)))", m=mails, c=c, p=page),
        t("(<m> > 0 AND <p> <= 2 AND length(<c>) < 260 AND NOT <end>)", m=mails, c=c, p=page, end=matches(c, "[.!?。！？]")),
        matches(c, r"(?i)^\{[^}]+\}\s*@"),
        t("(<w> AND <m> > 0 AND length(<c>) < 420)", m=mails, c=c, w=matches(c, r"(?i)\b(?:university|institute|college|department|laboratory|labs|technologies)\b")),
        matches(c, r"(?i)\b(?:author names are listed|equal contribution|corresponding author|correspondence to|authors contributed equally)\b"),
    )


def is_section_opening(c: E) -> E:
    return matches(t("trim(<c>)", c=c), r"(?i)^(?:abstract|introduction|related work|background|method|methods|methodology|experiments|results|discussion|conclusion|references|appendix)\b")


def ends_sentence(c: E) -> E:
    return matches(t("trim(<c>)", c=c), r"[.!?。！？][\x22\x27)\]]*$")


def starts_continuation(c: E) -> E:
    clean = t("trim(<c>)", c=c)
    return any_of(matches(clean, r"^[a-z0-9,;:()\[\]\-–—]"), matches(clean, r"(?i)^(?:et\s+al\.|i\.e\.|e\.g\.)"))


def is_resource_link(c: E) -> E:
    clean = collapse(c)
    return all_of(matches(clean, "(?i)" + URL), matches(clean, r"(?i)\b(?:github|gitlab|huggingface|kaggle|zenodo|osf\.io|openreview|paperswithcode|dataset|datasets|code|repository|repo|artifact|checkpoint|model|models|benchmark)\b"))


def is_link_line(c: E) -> E:
    """A URL in under 260 characters, with ten other words at most or more than 0.35 of the characters in URLs."""
    rest = t("trim(<r>)", r=replace(replace(replace(c, "(?i)" + URL, " "), r"\b\d+\b", " "), r"[^\p{L}]+", " "))
    words = t("CASE WHEN <r> = '' THEN 0 ELSE <n> END", r=rest, n=count(rest, r"\S+"))
    chars = t("(length(<c>) - length(<r>))", c=c, r=replace(c, "(?i)" + URL, ""))
    parts = {"u": count(c, "(?i)" + URL), "c": c, "w": words, "n": chars}
    spark, duck = t("(length(<c>) < 260 AND <u> > 0 AND (<w> <= 10 OR <n> > 0.35 * length(<c>)))", **parts), t("(<u> > 0 AND length(<c>) < 260 AND (<w> <= 10 OR <n> > 0.35 * length(<c>)))", **parts)
    return E(spark.s, duck.d)


def is_artifact_link(c: E) -> E:
    clean = paragraph(c)
    words = count(replace(clean, "(?i)" + URL, " "), r"\S+")
    return t(
        "(<ok> AND <a> AND <b> AND <w> <= 22)", ok=between(clean, 1, 320), w=words,
        a=matches(clean, r"(?i)\b(?:figure|fig\.|table|appendix|supplementary|github|code|dataset|artifact|artifact\s+available)\b"),
        b=matches(clean, r"(?i)(?:https?://|www\.|doi\.org|arxiv\.org|github\.com|huggingface\.co)"),
    )


def is_publication_metadata(c: E) -> E:
    return once(collapse(c), _is_publication_metadata, "flat")


def _is_publication_metadata(clean: E) -> E:
    nth = "first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth|eleventh|twelfth|thirteenth|fourteenth|fifteenth|sixteenth|seventeenth|eighteenth|nineteenth|twentieth"
    return any_of(
        matches(clean, r"(?i)\b(?:ACM Reference Format|Permission to make digital|Copyright held by|Proceedings of|ISBN|ISSN|DOI:|https://doi\.org|arXiv:\d|Creative Commons|©)\b"),
        matches(clean, r"(?i)^EUROSYS\s+[’\x27\d]"),
        matches(clean, VENUE_DATE_PLACE),
        all_of(between(clean, 1, 180), matches(clean, VENUE_HEADER), t("NOT <m>", m=matches(clean, "[.!?。！？]"))),
        all_of(between(clean, 1, 220), matches(clean, rf"(?i)^(?:the\s+)?(?:\d{{1,2}}(?:st|nd|rd|th)|{nth})\s+international\s+conference\s+on\b")),
    )


def is_bibliography_entry(c: E) -> E:
    return once(collapse(c), _is_bibliography_entry, "flat")


def _is_bibliography_entry(clean: E) -> E:
    reviewed, short = matches(clean, r"(?i)\b(?:In Proceedings of|Journal of|Conference on|Transactions on|arXiv preprint)\b"), t("length(<c>) < 420", c=clean)
    return any_of(
        matches(clean, r"^\[\d+\]\s+"),
        matches(clean, r"(?:^|https?://\S+\s+)\[\d+\]\s+[A-Z]"),
        all_of(matches(clean, r"^\d{4}\.\s+[A-Z]"), matches(clean, r"(?i)\b(?:arXiv|Proceedings|Conference|Journal|Transactions|doi:|https?://)")),
        all_of(matches(clean, r"(?i)\barXiv:\d{4}\.\d{4,5}\b"), matches(clean, r"(?i)(?:\[\d+\]|\b(?:Proceedings|Conference|Journal|Transactions|preprint)\b)")),
        matches(clean, r"^\d+\.\s+[A-Z][A-Za-z-]+,\s+[A-Z]"),
        E(all_of(short, reviewed).s, all_of(reviewed, short).d),
    )


def is_running_title(c: E) -> E:
    """A title-like line of 38 to 120 characters: five capitalised words or acronyms, and a separator."""
    clean = collapse(c)
    words = t("<a> + <b>", a=count(clean, r"\b[A-Z][A-Za-z0-9+-]{2,}\b"), b=count(clean, r"\b[A-Z0-9]{2,}\b"))
    return t(
        "(<ok> AND NOT <end> AND NOT <num> AND NOT <head> AND <w> >= 5 AND <sep>)", ok=between(clean, 38, 120), w=words, end=matches(clean, "[.!?。！？]$"), num=matches(clean, r"^\d+(?:\.\d+)*\s+"),
        head=matches(clean, r"(?i)^(?:abstract|introduction|background|method|approach|evaluation|experiments?|results?|discussion|conclusion|appendix|references)\b"), sep=matches(clean, "[:：]|[–—-]"),
    )


def is_page_number_or_header(c: E) -> E:
    clean = collapse(c)
    name = r"[A-Z][A-Za-z\x27’-]+(?:\s+[A-Z][A-Za-z\x27’-]+){0,3}\s+et\s+al\.?"
    return all_of(between(clean, 1, 120), any_of(
        matches(clean, rf"(?i)^(?:\d+(?:\.\d+)?\s+)*{name}(?:\s+\d+(?:\.\d+)?)*$"), is_running_title(clean),
        matches(clean, r"^(?:\d+\s*/\s*)?\d+$"), matches(clean, r"(?i)^page\s+\d+(?:\s+of\s+\d+)?$"),
        all_of(matches(clean, r"(?i)^(?:preprint|draft|submitted|accepted|published|proceedings|conference|workshop)\b"), t("NOT <m>", m=matches(clean, "[.!?。！？]"))),
    ))


def is_extraction_garbage(c: E, flat: E | None = None) -> E:
    """flat: for Spark, a column with c collapsed."""
    controls = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"

    def judged(clean: E) -> E:
        parts = {"n": count(c, controls), "latex": matches(clean, r"(?i)<latexit\b|sha1_base64=|AAAy[A-Za-z0-9+/=]{80,}"), "dense": matches(clean, "[A-Za-z0-9+/=]{180,}"), "eq": matches(clean, "[=<>]"), "c": clean}
        duck = t("(<c> <> '' AND ((<n> >= 1 AND length(<c>) > 20) OR (<n> >= 3 AND <n> > 0.015 * length(<c>)) OR (<latex> AND length(<c>) > 160) OR (<dense> AND <eq> AND length(<c>) > 260)))", **parts)
        # the same for Spark, lengths and single signs first: controls are counted where there is one
        spark = t(
            "(<c> <> '' AND ((<some> AND ((length(<c>) > 20) OR (<n> >= 3 AND <n> > 0.015 * length(<c>)))) OR (length(<c>) > 160 AND <latex>) OR (length(<c>) > 260 AND <eq> AND <dense>)))",
            some=matches(c, controls), **parts,
        )
        return E(spark.s, duck.d)

    return once(E((flat or collapse(c)).s, collapse(c).d), judged, "flat")


def is_table_body(c: E, lines: E) -> E:
    """Table text, by metric words, numbers and separators against the mean line length."""
    clean = collapse(c)
    n, m = count(clean, r"\b\d+(?:[.,]\d+)*%?\b"), count(clean, rf"(?i)\b(?:{METRIC_WORDS})\b")
    seps = count(clean, r"\||(?:^|\s)[|:](?:\s|$)")
    mean = t("length(<c>) / greatest(<l>, 1)", c=clean, l=lines)
    return t(
        "(<ok> AND NOT <end> AND ((<row> AND <m> >= 2) OR (<m> >= 3 AND <n> >= 2 AND ((<l> >= 2 AND <mean> <= 80) OR <s> >= 1)) OR (<m> >= 4 AND <n> >= 3 AND <mean> <= 96)))",
        ok=between(clean, 1, 360), end=matches(clean, r"[.!?。！？][)\x22\x27\]]?(?:\s|$)"), row=matches(clean, r"^\|?.+\|.+\|"), m=m, n=n, s=seps, mean=mean, l=lines,
    )


#: Reasons in order of precedence.
def noise_reasons(c: E, page: E, lines: E) -> dict[str, E]:
    return {
        "garbage": is_extraction_garbage(c), "caption": is_caption(collapse(c)), "metadata": is_publication_metadata(c), "author": is_author_line(c, page), "link": is_link_line(c),
        "bibliography": is_bibliography_entry(c), "page_header": is_page_number_or_header(c), "references_title": is_references_title(c), "table_body": is_table_body(c, lines),
    }


# -- extraction --------------------------------------------------------------------------------------


def urls(c: E) -> E:
    return extract_all(c, r"(?i)https?://[^\s)\]}>,;]+|www\.[^\s)\]}>,;]+")


def normal_url(c: E) -> E:
    clean = replace(c, r"[.,;:)\]}]+$", "")
    return t("CASE WHEN <u> LIKE 'www.%' THEN concat('https://', <u>) ELSE <u> END", u=clean)


def resource_type(c: E) -> E:
    low = t("lower(<c>)", c=c)
    return t(
        "CASE WHEN <a> THEN 'code' WHEN <b> THEN 'dataset' WHEN <p> THEN 'paper' WHEN <c> <> '' THEN 'url' ELSE '' END", c=c,
        a=matches(low, r"github\.com|gitlab\.com|bitbucket\.org"), b=matches(low, r"huggingface\.co|kaggle\.com|zenodo\.org|figshare\.com|dataset|data"), p=matches(low, r"arxiv\.org|doi\.org|openreview\.net"),
    )


LABEL = r"(?i)^(fig(?:ure)?|table|tab|equation|eq)s?\.?\s*[:.]?\s*\(?\s*(\d+)\s*\)?(?:\s*\(([a-z])\)|([a-z])\b)?"
REFERENCES = r"(?i)\b(fig(?:ure)?s?\.?|tables?|tabs?\.?|eq(?:uation)?s?\.?)\s*[:.]?\s*\(?\s*(\d+)\s*\)?(?:\s*\(([a-z])\)|([a-z])\b)?"


def reference_kind(c: E) -> E:
    low = t("lower(<c>)", c=c)
    return t("CASE WHEN <l> LIKE 'fig%' THEN 'figure' WHEN <l> LIKE 'tab%' THEN 'table' WHEN <l> LIKE 'eq%' THEN 'equation' END", l=low)


def label_key(c: E, pattern: str = LABEL) -> E:
    """`figure:7b` for `Fig. 7(b)`; empty if the text begins with no label."""
    clean = collapse(c)
    g = [extract(clean, pattern, k) for k in range(5)]
    return t("CASE WHEN <n> = '' THEN '' ELSE concat(<k>, ':', CAST(CAST(<n> AS INT) AS STRING), lower(<a>), lower(<b>)) END", n=g[2], k=reference_kind(g[1]), a=g[3], b=g[4])


TEXT = x("text")
