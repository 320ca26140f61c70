"""Column expressions of the attention jobs; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Namespaces that are not articles, as prefixes of raw titles.
NAMESPACES = (
    "Media", "Special", "Talk", "User", "User_talk", "Wikipedia", "Wikipedia_talk",
    "File", "File_talk", "MediaWiki", "MediaWiki_talk", "Template", "Template_talk",
    "Help", "Help_talk", "Category", "Category_talk", "Portal", "Portal_talk",
    "Draft", "Draft_talk", "TimedText", "TimedText_talk", "Module", "Module_talk",
    "WP", "WT", "Image", "Image_talk",
)
# Link prefixes outside the main namespace, lower case.
LINK_PREFIXES = (
    "file", "image", "category", "wikipedia", "wp", "help", "template", "portal",
    "talk", "special", "module", "mos", "draft", "user", "media", "mediawiki",
    "book", "timedtext", "gadget", "topic", "s", "wikt", "commons", "c", "d",
    "meta", "m", "q", "b", "n", "v", "voy", "arxiv", "doi", "isbn", "oclc",
    "pmid", "rfc", "simple",
)
# Legal words at either end of a company's name.
LEGAL_WORDS = (
    "inc", "incorporated", "corp", "corporation", "co", "company", "companies",
    "ltd", "limited", "llc", "lp", "plc", "sa", "ag", "nv", "se", "spa",
    "holdings", "holding", "group", "groupe", "the",
)
# Words of titles that say nothing about a theme.
STOPWORDS = (
    "the", "of", "in", "on", "at", "to", "for", "and", "or", "a", "an",
    "list", "timeline", "history", "effects", "impact", "aftermath",
    "response", "reactions", "casualties", "deaths", "victims",
    "united", "states", "state", "national", "international", "world",
    "new", "old", "first", "second", "third", "century", "year", "years",
)
# Wikis whose name is not a language.
OTHER_WIKIS = ("commonswiki", "wikidatawiki", "metawiki", "specieswiki", "incubatorwiki", "loginwiki", "mediawikiwiki", "sourceswiki", "outreachwiki", "testwiki")
# Thresholds of the decision.
MIN_EDITS, MIN_VIEWS, MIN_RATIO, MIN_Z, MIN_DAYS = 1, 100, 2.0, 3.0, 7
# Entities that lead texts hold, & last.
ENTITIES = (("&nbsp;", " "), ("&#160;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))

HOUR = "hour"


def canonical_title(c: Column) -> Column:
    """Runs of blanks and underscores become one blank; only blanks are stripped."""
    return F.trim(F.regexp_replace(c, "[ _]+", " "))


def link_key(c: Column) -> Column:
    """Key to compare link targets by: as the title, any white space collapsed, first letter upper case."""
    t = F.trim(F.regexp_replace(c, r"(?U)[\s_]+", " "))
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substr(t, F.lit(2)))


def is_content_title(c: Column) -> Column:
    """Raw titles of articles: not '-', and no namespace before the first colon."""
    return (c != "-") & ~(F.contains(c, F.lit(":")) & F.substring_index(c, ":", 1).isin(*NAMESPACES))


#: Fixed value: a link of wikitext, its target as the group.
LINK = r"\[\[([^\[\]|]+)(?:\|[^\[\]]*)?\]\]"


def wikitext_links(c: Column) -> Column:
    """Distinct sorted keys of the literal links into the main namespace."""
    targets = F.transform(F.regexp_extract_all(c, F.lit(LINK), F.lit(1)), lambda t: F.trim(F.substring_index(t, "#", 1)))

    def main(t: Column) -> Column:
        prefix = F.lower(F.trim(F.substring_index(t, ":", 1)))
        return (t != "") & ~t.startswith(":") & ~(F.contains(t, F.lit(":")) & (prefix.isin(*LINK_PREFIXES) | prefix.rlike("^[a-z]{2,3}(-[a-z]{2,8})?$")))

    return F.array_sort(F.array_distinct(F.filter(F.transform(F.filter(targets, main), link_key), lambda k: k != "")))


def hour_floor(c: Column) -> Column:
    return F.date_trunc(HOUR, c)


def hour_of_day(c: Column) -> Column:
    return F.hour(c)


def file_hour(name: Column) -> Column:
    """Start of the hour that a file covers; its name tells the end."""
    at = F.try_to_timestamp(F.regexp_extract(name, r"(\d{8}-\d{6})", 1), F.lit("yyyyMMdd-HHmmss"))
    return at - F.expr("interval 1 hour")


def safe_row_floor(least: int, projects: int) -> int:
    """The smallest row that can matter when a title's rows over so many projects must sum to least."""
    return -(-least // projects)


def mobile_ratio(mobile: Column, views: Column) -> Column:
    return F.when(views > 0, mobile / views)


def domain_of_wiki(c: Column) -> Column:
    """Domain of a language wiki, else null."""
    lang = F.regexp_extract(c, "^([a-z][a-z0-9_-]*)wiki$", 1)
    return F.when((lang != "") & ~c.isin(*OTHER_WIKIS), F.concat(F.translate(lang, "_", "-"), F.lit(".wikipedia.org")))


def meta_id(wiki: Column, rev_id: Column) -> Column:
    return F.concat_ws(":", F.lit("dump"), wiki, rev_id.cast("string"))


def issue_key(source: Column, wiki: Column, title: Column) -> Column:
    return F.concat_ws(":", source, wiki, title)


def document_key(key: Column) -> Column:
    """The issue key without its source, if it has the shape source:wiki:title."""
    shaped = key.like("live:_%:_%") | key.like("replay:_%:_%")
    return F.when(shaped, F.substr(key, F.instr(key, ":") + 1)).otherwise(key)


def decode_hourly(c: Column) -> Column:
    """C2G1 as array<(h, v)>; leftovers give null; a repeated letter stands twice and adds up when summed."""
    pairs = F.regexp_extract_all(c, F.lit(r"([A-X]\d+)"), F.lit(1))
    out = F.transform(pairs, lambda p: F.struct((F.ascii(p) - 65).alias("h"), F.substr(p, F.lit(2)).cast("long").alias("v")))
    return F.when(F.regexp_replace(c, r"[A-X]\d+", "") == "", out)


def decay_weight(age: Column, half_life: float) -> Column:
    if half_life <= 0:
        raise ValueError("half-life must be positive")
    return F.pow(F.lit(0.5), age / half_life)


def z_score(value: Column, mean: Column, deviation: Column) -> Column:
    return F.when(deviation > 0, (value - mean) / deviation)


def spike_score(views: Column, mean: Column) -> Column:
    """How far views stand above what is usual, on a log scale."""
    usual = F.when(mean > 0, mean).otherwise(F.lit(0.0))
    return F.round(F.log1p(F.greatest(F.lit(0.0), views - usual)), 3)


def detect(edits: Column, views: Column, edit_mean: Column, edit_deviation: Column, view_mean: Column, view_deviation: Column, days: Column) -> Column:
    """The three-state decision as a struct of status, is_new_page, edit_z, view_ratio, view_z, spike_score and reason."""
    thin = days.isNull() | (days < MIN_DAYS)
    usable = ~thin & F.coalesce(view_mean > 0, F.lit(False))
    ratio = F.when(usable, views / view_mean)
    z = F.when(usable, z_score(views, view_mean, view_deviation))
    enough = views >= MIN_VIEWS
    confirmed = F.when(~usable, enough).when(z.isNull(), enough & (ratio >= MIN_RATIO)).otherwise(enough & (ratio >= MIN_RATIO) & (z >= MIN_Z))
    status = F.when(F.coalesce(edits, F.lit(0)) < MIN_EDITS, "REJECTED").when(views.isNull(), "PENDING_VIEWS").when(confirmed, "CONFIRMED").otherwise("REJECTED")
    reason = F.when(F.coalesce(edits, F.lit(0)) < MIN_EDITS, "no_edits").when(views.isNull(), "no_views").when(~usable, "floor").when(z.isNull(), "ratio").otherwise("full")
    return F.struct(
        status.alias("status"), days.isNull().alias("is_new_page"), F.when(~thin, z_score(edits, edit_mean, edit_deviation)).alias("edit_z"),
        ratio.alias("view_ratio"), z.alias("view_z"), F.when(status == "CONFIRMED", spike_score(views, view_mean)).otherwise(F.lit(0.0)).alias("spike_score"), reason.alias("reason"),
    )


def size_score(c: Column) -> Column:
    return F.round(c / (c + 5), 4)


def completeness(views: Column) -> Column:
    return F.when(views.isNull(), "pending").otherwise("complete")


def org_key(c: Column) -> Column:
    """Comparable form of a company's name: lower case, no punctuation, no legal words at either end."""
    words = "|".join(LEGAL_WORDS)
    t = F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))
    t = F.regexp_replace(t, rf"(?:(?:^|\s)(?:{words}))+$", "")
    return F.trim(F.regexp_replace(t, rf"^(?:(?:{words})(?:\s|$))+", ""))


def title_terms(c: Column) -> Column:
    """Words of a title that may name a theme."""
    words = F.split(F.lower(F.regexp_replace(c, r"\([^)]*\)", " ")), "[^0-9a-z]+")
    return F.filter(words, lambda w: (F.char_length(w) >= 4) & ~w.rlike("^[0-9]+$") & ~w.isin(*STOPWORDS))


def first_sentences(c: Column, n: Column | int) -> Column:
    """The first n sentences, cut at '. ', without dots at the end."""
    return F.regexp_replace(F.array_join(F.slice(F.split(c, r"\. "), F.lit(1), F.lit(n) if isinstance(n, int) else n), ". "), r"\.+$", "")


def sentence_budget(pages: Column) -> Column:
    return F.when(pages <= 1, 6).when(pages <= 3, 4).otherwise(2)


def fit_lead(c: Column, budget: int) -> Column:
    """The first sentence and as many of the last ones as fit the budget, in order."""
    parts = F.split(c, r"\. ")
    rest = F.reverse(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))))
    head = F.get(parts, 0)
    start = F.struct(F.char_length(head).alias("used"), F.array().cast("array<string>").alias("kept"), F.lit(True).alias("open"))

    def step(x: Column, s: Column) -> Column:
        fits = x["open"] & (x["used"] + F.char_length(s) + 2 <= budget)
        return F.struct(F.when(fits, x["used"] + F.char_length(s) + 2).otherwise(x["used"]).alias("used"), F.when(fits, F.concat(F.array(s), x["kept"])).otherwise(x["kept"]).alias("kept"), fits.alias("open"))

    return F.aggregate(rest, start, step, lambda x: F.left(F.concat_ws(". ", F.concat(F.array(head), x["kept"])), F.lit(budget)))


def lead_from_html(c: Column) -> Column:
    """Text of the paragraphs of a page, without tables, styles, figures and superscripts."""
    body = F.regexp_replace(c, r"(?is)<(table|style|figure|sup)\b[^>]*>.*?</\1>", "")
    parts = F.transform(F.regexp_extract_all(body, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1)), lambda p: F.regexp_replace(p, r"(?s)<[^>]+>", ""))
    text = F.array_join(parts, " ")
    for name, sign in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def is_new(first: Column, snapshot: Column, hours: int = 24) -> Column:
    age = F.unix_timestamp(snapshot) - F.unix_timestamp(first)
    return (age >= 0) & (age < hours * 3600)


def display_title(label: Column, ko: Column, machine: Column, title: Column) -> Column:
    """A Hangul label, else the Korean title, else the machine's, else label, else title."""
    full = lambda x: F.when(F.trim(x) != "", F.trim(x))
    return F.coalesce(F.when(label.rlike(r"[\x{AC00}-\x{D7A3}]"), F.trim(label)), full(ko), full(machine), full(label), full(title), F.lit("-"))


def slot_floor(c: Column, seconds: int = 900) -> Column:
    return F.timestamp_seconds(F.floor(F.unix_timestamp(c) / seconds) * seconds)


def slots(a: Column, b: Column) -> Column:
    """Every 15-minute slot from a to b, both included."""
    return F.sequence(slot_floor(a), slot_floor(b), F.expr("interval 15 minutes"))


def ranking_window(as_of: Column, zone: str = "Asia/Seoul") -> Column:
    """Starts of the last 30 days and of the same date last year, by the local calendar."""
    local = F.from_utc_timestamp(as_of, zone)
    year = F.to_timestamp(F.concat_ws(" ", F.add_months(F.to_date(local), -12).cast("string"), F.date_format(local, "HH:mm:ss")))
    return F.struct((as_of - F.expr("interval 30 days")).alias("month_from"), F.to_utc_timestamp(year, zone).alias("year_from"))


def baseline_as_of(now: Column) -> Column:
    """Last day whose windows can no longer be pending."""
    return F.date_sub(F.to_date(now - F.expr("interval 38 hours")), 1)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def to_second(c: Column) -> Column:
    return F.date_trunc("second", c)


def clean_sector(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def article_record(fields: Column) -> Column:
    """Struct of doc_id, orgs, themes and locations from a row of at least 27 fields, else null."""
    full = lambda a: F.filter(F.transform(a, lambda x: F.trim(x)), lambda x: x != "")
    at = lambda i: F.get(fields, i)
    first = full(F.transform(F.split(at(13), ";"), F.lower))
    second = full(F.transform(F.split(at(14), ";"), lambda x: F.lower(F.substring_index(x, ",", 1))))
    places = full(F.transform(F.split(at(9), ";"), lambda x: F.lower(F.coalesce(F.get(F.split(x, "#"), 1), F.lit("")))))
    record = F.struct(F.coalesce(F.nullif(at(4), F.lit("")), at(0)).alias("doc_id"), F.array_sort(F.array_union(first, second)).alias("orgs"), full(F.transform(F.split(at(7), ";"), F.upper)).alias("themes"), places.alias("locations"))
    return F.when(F.size(fields) >= 27, record)
