"""Text functions of the exam corpus as column expressions; all but the text gate, whose parts are bound to lambda variables, run inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space beyond ASCII, written out, since the JVM's \s is ASCII only.
SPACE = r"[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"

# Furniture that hashing ignores, applied in this order to lower-cased text ({s} is white space).
FURNITURE = (
    r"(?m)^{s}*page{s}+\d+{s}*(of{s}+\d+)?{s}*$",
    r"(?m)^{s}*-?{s}*\d+{s}*-?{s}*$",
    r"reg(?:ister)?\.?{s}*(?:no|number)\.?{s}*[:.]?{s}*[a-z0-9]*",
    r"roll\.?{s}*(?:no|number)\.?{s}*[:.]?{s}*[a-z0-9]*",
    r"seat{s}*(?:no|number)\.?{s}*[:.]?{s}*[a-z0-9]*",
    r"question{s}+paper{s}+code{s}*[:.]?{s}*[a-z0-9]*",
)
# The stop words of the quality gate.
COMMON = ("the", "and", "of", "to", "in", "is", "for", "with", "that", "a", "are", "on", "be", "as", "by", "an", "or", "which", "from", "this")
# Mark bands.
BANDS = (2, 5, 8, 13, 15)


def hash_normal(text: Column) -> Column:
    """The text that content hashes see; null stays null."""
    out = F.lower(text)
    for pattern in FURNITURE:
        out = F.regexp_replace(out, pattern.replace("{s}", SPACE), " ")
    out = F.translate(out, "\u2018\u2019\u201c\u201d\u00a0", "''\"\" ")
    return F.trim(F.regexp_replace(out, SPACE + "+", " "))


def content_hash(text: Column) -> Column:
    return F.sha2(hash_normal(text), 256)


def paper_hash(text: Column, content: Column, prefix: str = "provisional:") -> Column:
    """struct(hash, provisional): by text where the gate passes, else by the raw bytes in a hash family of their own."""
    usable = F.coalesce(quality(text)["usable"], F.lit(False))
    raw = F.sha2(F.concat(F.lit(prefix).cast("binary"), content), 256)
    return F.struct(F.when(usable, content_hash(text)).otherwise(raw).alias("hash"), (~usable).alias("provisional"))


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def _bound(value: Column, use) -> Column:
    """use(value), for which the value is worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


# The characters of SPACE, and those beyond Latin 1, which few texts have: classes of single Latin characters are matched much faster.
BLANKS = " \t\n\x0b\x0c\r\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
FAR = r"[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _flat(t: Column) -> Column:
    """t with one blank for each run of white space."""
    near = F.when(t.rlike(r"[^\x00-\x{167F}]"), F.regexp_replace(t, FAR, " ")).otherwise(t)
    return F.regexp_replace(near, r"[ \t\n\x0B\f\r\xA0]+", " ")


def _measured(t: Column) -> Column:
    """struct of counts of a trimmed text: characters, words, those that mix letters with digits or marks, and so on; each in one linear pass."""
    dotted, kelvin = F.lit("\u0130"), F.lit("\u212a")  # the two other letters that are i and k in lower case
    plain = F.when(t.contains(dotted) | t.contains(kelvin), F.replace(F.replace(t, dotted, F.lit("i")), kelvin, F.lit("k"))).otherwise(t)
    padded = F.concat(F.lit(" "), F.lower(F.regexp_replace(plain, "[^a-zA-Z0-9]+", " ")), F.lit(" "))

    def counts(x: Column) -> Column:
        solid = F.length(F.replace(x["flat"], F.lit(" "), F.lit("")))
        common = sum((F.when(x["padded"].contains(f" {w} "), 1).otherwise(0) for w in COMMON), F.lit(0))
        # What is left without words that have no letter, or no digit or mark, is mixed words. Words are taken whole, never from their middle.
        mixed = F.regexp_replace(x["flat"], "(?<![^ ])(?:[^ a-zA-Z]++|[^ 0-9~^|]++)(?![^ ])", "")
        return F.struct(
            F.length(t).alias("size"), F.length(F.regexp_replace(t, "[^a-zA-Z]+", "")).alias("letters"), F.regexp_count(t, F.lit(r"[^\w\s]{4,}")).alias("punct"),
            solid.alias("solid"), (F.length(x["flat"]) - solid + 1).alias("n"), common.alias("common"), F.regexp_count(mixed, F.lit("[^ ]+")).alias("mixed"),
        )

    return _bound(F.struct(_flat(t).alias("flat"), padded.alias("padded")), counts)


def _judged(m: Column) -> Column:
    size, n = m["size"], m["n"]
    alpha, punct, garbled, common = _share(m["letters"], m["solid"]), _share(m["punct"], n), _share(m["mixed"], n), m["common"] / F.lit(float(len(COMMON)))
    score = 0.30 * F.least(alpha / 0.9, F.lit(1.0)) + 0.35 * (1 - F.least(punct / 0.013, F.lit(1.0))) + 0.10 * (1 - F.least(garbled / 0.2, F.lit(1.0))) + 0.25 * common
    reason = F.when(size < 200, "short").when(n < 50, "few words").when(alpha < 0.70, "letters").when(punct > 0.008, "punctuation").when(common < 0.45, "stop words").when(garbled > 0.15, "garbled")
    return F.struct(reason.isNull().alias("usable"), F.when((size < 200) | (n < 50), F.lit(0.0)).otherwise(score).alias("score"), reason.alias("reason"))


def quality(text: Column) -> Column:
    """struct(usable, score, reason) of a text layer; a null text is an empty one. The first test that fails gives the reason."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return _bound(trimmed, lambda t: _bound(_measured(t), _judged))


def route(text: Column) -> Column:
    """Where a paper's text comes from: vision under 40 characters, recovered OCR where the gate fails, else digital."""
    bare = F.length(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(bare < 40, "vision").when(quality(text)["usable"], "digital").otherwise("dirty_ocr_recovered")


def _int(text: Column) -> Column:
    return F.nullif(text, F.lit("")).try_cast("int")


def tidy(text: Column) -> Column:
    """text without white space at both ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def trailing_marks(text: Column) -> Column:
    """struct(clean, marks): a final bracketed mark of 1 to 100 is taken off; otherwise the text stays and marks are null."""
    pattern = r"(?i)[(\[](\d{1,2})" + SPACE + r"*(?:marks?|m)?[)\]]" + SPACE + "*$"
    found = _int(F.regexp_extract(text, pattern, 1))
    fine = found.between(1, 100)
    return F.struct(F.when(fine, tidy(F.regexp_replace(text, pattern, ""))).otherwise(text).alias("clean"), F.when(fine, found).alias("marks"))


def part_header(text: Column) -> Column:
    """struct(part, slots, per, total, recovered) of a part heading, null if the line is none.

    `n x m = t` is read as printed. Where the equals sign is lost, the digits after the cross are cut at the first place
    at which slots times marks gives the total, neither being zero; where no place does, they are the marks of one slot.
    A heading without arithmetic has zeros.
    """
    tight = F.upper(F.regexp_replace(text, SPACE + "+", ""))
    head = r"^\(?PART[-–—:.]*([ABC])(?![A-Z])"  # fixed value: how part headings begin
    part = F.regexp_extract(tight, head, 1)
    rest = F.regexp_replace(tight, head, "")
    printed, lost = r"(\d+)[X×*](\d+)=(\d+)", r"(\d+)[X×*](\d+)"
    slots, digits = _int(F.regexp_extract(rest, lost, 1)), F.regexp_extract(rest, lost, 2)
    cuts = F.when(F.length(digits) > 1, F.sequence(F.lit(1), F.length(digits) - 1))
    sides = F.transform(cuts, lambda i: F.struct(F.substring(digits, F.lit(1), i).try_cast("int").alias("per"), F.substring(digits, i + 1, F.length(digits)).try_cast("int").alias("total")))
    fit = F.get(F.filter(sides, lambda s: (s["per"] > 0) & (s["total"] > 0) & (s["per"] * slots == s["total"])), F.lit(0))
    row = lambda s, p, t, r: F.struct(part.alias("part"), s.alias("slots"), p.alias("per"), t.alias("total"), F.lit(r).alias("recovered"))
    whole = [_int(F.regexp_extract(rest, printed, i)) for i in (1, 2, 3)]
    per, zero = F.coalesce(fit["per"], _int(digits)), F.lit(0)
    found = F.when(rest.rlike(printed), row(*whole, False)).when(rest.rlike(lost), row(slots, per, F.coalesce(fit["total"], slots * per), True)).otherwise(row(zero, zero, zero, True))
    return F.when((F.length(text) <= 90) & (part != ""), found)


# The patterns of the lines around questions, and of the starts of questions and their parts.
QUESTION_START = r"^\(?\s*(\d{1,2})\s*[.)]?\s*(?:\(\s*([a-dA-D])\s*\))?\s*"
PART_START = r"^\(\s*([^)\s]{0,4})\s*\)\s*"


def furniture(text: Column) -> Column:
    return text.rlike(r"(?i)^page\s*\d+\s*(of|/)\s*\d+$") | text.rlike(r"(?i)^roll\s*\.?\s*no\.?[\s._]*$") | ~text.rlike("[A-Za-z0-9]")


def table_header(text: Column) -> Column:
    return text.rlike(r"(?i)q\s*\.?\s*no\.?") & text.rlike("(?i)marks")


def or_marker(text: Column, x: Column, page_width: Column) -> Column:
    """The word between alternatives: it stands alone, and not at the left edge."""
    return text.rlike(r"(?i)^o\s*\.?\s*r\.?$") & (x > page_width * 0.2)


def note(text: Column) -> Column:
    """Instructions in brackets under a heading; a part of a question is none."""
    trimmed = tidy(text)
    return (F.length(trimmed) <= 90) & trimmed.startswith("(") & trimmed.contains(")") & ~trimmed.rlike(PART_START)


def line_class(text: Column, x: Column, page_width: Column) -> Column:
    """What a line of a paper is: furniture, part, note, header (of the question table), or (centred), or body."""
    kinds = (("furniture", furniture(text)), ("part", part_header(text).isNotNull()), ("note", note(text)), ("header", table_header(text)), ("or", or_marker(text, x, page_width)))
    return F.coalesce(*[F.when(hit, name) for name, hit in kinds], F.lit("body"))


def question_number(raw: Column, label: Column | None = None) -> Column:
    """struct(number, label): leading digits (else the raw number, trimmed), then runs of letters in order, once each, hyphened."""
    both = F.concat(F.coalesce(raw, F.lit("")), F.coalesce(label, F.lit(""))) if label is not None else F.coalesce(raw, F.lit(""))
    lead = r"^\s*(\d{1,3})"
    number = F.coalesce(F.nullif(F.regexp_extract(both, lead, 1), F.lit("")), tidy(F.coalesce(raw, F.lit(""))))
    rest = F.lower(F.regexp_replace(both, lead, ""))
    parts = F.array_join(F.array_distinct(F.regexp_extract_all(rest, F.lit("[a-z]+"), F.lit(0))), "-")
    return F.struct(number.alias("number"), F.nullif(parts, F.lit("")).alias("label"))


def normal_question(number: Column, label: Column, part: Column, or_group: Column, text: Column) -> Column:
    """struct(number, label, or_group, text): compulsory parts A and C have no alternatives, blanks and tabs shrink to one blank."""
    split = question_number(number, label)
    group = F.when(part.isin("A", "C"), F.lit(None)).otherwise(or_group)
    return F.struct(split["number"].alias("number"), split["label"].alias("label"), group.alias("or_group"), tidy(F.regexp_replace(text, r"[ \t]+", " ")).alias("text"))


def college(text: Column) -> Column:
    return F.when(F.upper(text).rlike(r"\bCEG\b"), "CEG").when(F.upper(text).rlike(r"\bMIT\b"), "MIT")


def regulation(text: Column) -> Column:
    return F.concat(F.lit("R"), F.nullif(F.regexp_extract(text, r"(\d{4})", 1), F.lit("")))


def subject_code(text: Column) -> Column:
    tight = F.upper(F.regexp_replace(text, r"[\s_-]", ""))
    return F.when(tight.rlike(r"^[A-Z]{2,3}\d{4,5}$"), tight)


def filename_hints(name: Column, college_pattern: tuple[str, str] = (r"\bCEG\b", r"\bMIT\b")) -> Column:
    """struct(exam_type, college, paper_set, exam_year) that a file name tells; crawls and workers differ in college_pattern."""
    upper = F.upper(F.regexp_replace(name, r"(?i)\.pdf$", ""))
    # Words of file names, the first that occurs decides.
    words = {"supplementary": "SUPPLEMENTARY", "retest": "RE-?TEST", "quiz": "QUIZ", "assessment": "ASSESS", "endsem": "ENDSEM"}
    kind = F.coalesce(*[F.when(upper.rlike(p), k) for k, p in words.items()])
    year = _int(F.regexp_extract(upper, r"\b(\d{2})S\d\b", 1)) + 2000
    place = F.when(upper.rlike(college_pattern[0]), "CEG").when(upper.rlike(college_pattern[1]), "MIT")
    return F.struct(kind.alias("exam_type"), place.alias("college"), F.nullif(F.regexp_extract(upper, r"-(BT|OT|RT|GT)\b", 1), F.lit("")).alias("paper_set"), F.when(year.between(1990, 2100), year).alias("exam_year"))


#: The college pattern of workers.
WORKER_COLLEGE = ("-CEG-", "-MIT")


def band(marks: Column) -> Column:
    """The nearest mark band; of two as near, the lower."""
    return F.array_min(F.transform(F.array(*map(F.lit, BANDS)), lambda b: F.struct(F.abs(marks - b).alias("d"), b.alias("b"))))["b"]


def citation(year: Column, session: Column, number: Column, label: Column) -> Column:
    """As in 2023 NOV-DEC Q13(b): the whole session in capitals; what is null is left out."""
    place = F.concat(F.lit("Q"), number, F.coalesce(F.concat(F.lit("("), label, F.lit(")")), F.lit("")))
    return F.concat_ws(" ", year.cast("string"), F.upper(session), place)


def json_body(text: Column, schema: str) -> Column:
    """The JSON object inside a model's reply, fences and chatter left out; null where it does not parse."""
    return F.from_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1), schema, {"mode": "PERMISSIVE"})


def retry_advice(status: Column, message: Column, default_ms: int = 60_000) -> Column:
    """struct(retryable, after_ms) of a provider's failure."""
    text = F.coalesce(message, F.lit(""))
    # The words by which providers say "later".
    later = r"(?i)resource[_\s-]?exhausted|quota|rate.?limit|overloaded|unavailable|deadline"
    after = F.nullif(F.regexp_extract(text, r'(?i)retry(?:Delay|-after)"?[:\s]+"?(\d+)s?', 1), F.lit("")).try_cast("long") * 1000
    again = F.coalesce(status.isin(429, 408) | (status >= 500), F.lit(False)) | text.rlike(later)
    return F.struct(again.alias("retryable"), F.when(again, F.coalesce(after, F.lit(default_ms).cast("long"))).alias("after_ms"))


# Bounds of question and paper rows: column, lowest, highest.
BOUNDS = (("marks", 0, 100), ("co", 1, 12), ("bl", 1, 6), ("page_no", 1, None), ("confidence", 0, 1), ("exam_year", 1990, 2100), ("semester", 1, 12), ("total", 0, 1000))


def violations(columns: list[str]) -> Column:
    """The sorted names of the columns that break a rule; null values pass, columns without rules are not looked at.

    Numbers keep their bounds, q_number has 1 to 20 characters, text is not empty.
    """
    checks = []
    for name, low, high in BOUNDS:
        if name in columns:
            bad = F.col(name) < low if high is None else ~F.col(name).between(low, high)
            checks.append(F.when(bad, F.lit(name)))
    for name, most in (("q_number", 20), ("text", None)):
        if name in columns:
            size = F.length(name)
            checks.append(F.when(size < 1 if most is None else ~size.between(1, most), F.lit(name)))
    return F.array_sort(F.array_compact(F.array(*checks))) if checks else F.array().cast("array<string>")


# The enumerated domains that table checks hold rows to.
DOMAINS = {
    "exam_type": ("endsem", "assessment", "quiz", "supplementary", "retest"), "text_source": ("digital", "vision", "dirty_ocr_recovered"), "part": ("A", "B", "C"),
    "regime": ("high", "medium", "low"), "status": ("provisional", "confirmed", "disputed"), "kind": ("prerequisite", "related"), "mode": ("night_before", "mastery"), "depth": ("cram", "full"),
}


def broken_checks(columns: dict[str, str], loop: tuple[str, str] | None = None) -> Column:
    """The sorted names of broken table checks: columns (column -> domain) outside their domain, and a row that leads to itself."""
    checks = [F.when(~F.col(c).isin(*DOMAINS[d]), F.lit(c)) for c, d in columns.items()]
    if loop:
        checks.append(F.when(F.col(loop[0]) == F.col(loop[1]), F.lit("self_loop")))
    return F.array_sort(F.array_compact(F.array(*checks)))
