"""Text predicates and functions as column expressions.

Letters and digits are \\p{L} and \\p{Nd}; white space is Unicode's; offsets count code points. The
end-of-sentence tests differ on purpose: each belongs to another operator.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\p{Z}\s]+"
OTHER = r"[^\p{L}\p{Nd}]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def stripped(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), rf"^{SPACE}|{SPACE}$", "")


def blank(text: Column | str) -> Column:
    return stripped(text) == ""


def words(text: Column | str) -> Column:
    return F.filter(F.split(_c(text), SPACE), lambda w: w != "")


def word_offsets(text: Column | str) -> Column:
    """The words of a text with the place of each one's first character: (word, offset)."""
    empty = F.array().cast("array<struct<word:string,offset:int>>")
    parts = F.split(F.regexp_replace(_c(text), SPACE, " "), " ")  # every space run becomes one, so lengths come from the text itself
    gaps = F.regexp_extract_all(_c(text), F.lit(rf"({SPACE})"), F.lit(1))

    def step(s: Column, x: Column) -> Column:
        word, gap = x.getField("word"), F.coalesce(F.length(x.getField("gap")), F.lit(0))
        at = s.getField("at")
        found = F.when(word != "", F.array(F.struct(word.alias("word"), at.alias("offset")))).otherwise(empty)
        return F.struct((at + F.length(word) + gap).alias("at"), F.concat(s.getField("out"), found).alias("out"))

    zipped = F.zip_with(parts, gaps, lambda w, g: F.struct(w.alias("word"), g.alias("gap")))
    return F.aggregate(zipped, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda s: s.getField("out"))


def bare(word: Column | str) -> Column:
    """A word's letters and digits, in lower case."""
    return F.lower(F.regexp_replace(_c(word), OTHER, ""))


def bare_words(text: Column | str) -> Column:
    return F.filter(F.transform(words(text), bare), lambda w: w != "")


def normalised(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(_c(text)), OTHER + "+", " "))


def letters(text: Column | str) -> Column:
    return F.lower(F.regexp_replace(_c(text), r"\P{L}", ""))


def has_speech(text: Column | str) -> Column:
    return _c(text).rlike(r"[\p{L}\p{Nd}]")


def hallucinated(text: Column | str, avg_logprob: Column | str, no_speech: Column | str) -> Column:
    return (_c(no_speech) > 0.6) & (_c(avg_logprob) < -1) & ~blank(text)


def unformatted(text: Column | str) -> Column:
    return ~blank(text) & ~_c(text).rlike("[.,?!;:]") & ~_c(text).rlike(r"\p{Lu}")


def better_reading(current: Column | str, candidate: Column | str) -> Column:
    """Whether a formatted candidate of nearly as many words should replace an unformatted reading."""
    return unformatted(current) & ~unformatted(candidate) & (F.size(words(candidate)) >= F.size(words(current)) * 0.9)


def says_the_same(original: Column | str, candidate: Column | str, share: float = 0.7) -> Column:
    def same(s: Column) -> Column:
        before, after = s.getField("before"), s.getField("after")
        return (F.size(before) == 0) | (F.size(F.filter(before, lambda w: F.array_contains(after, w))) >= F.size(before) * share)

    # Within the filter the words would be taken apart anew for each word.
    return let(F.struct(bare_words(original).alias("before"), bare_words(candidate).alias("after")), same)


def ends_paragraph(text: Column | str) -> Column:
    """The last character that isn't space is a full stop, question or exclamation mark."""
    return _c(text).rlike(r"[.?!][\p{Z}\s]*$")


def ends_sentence(text: Column | str) -> Column:
    """As above past quotes and brackets, and with more marks; true if there is nothing else."""
    closing = r"[\p{Z}\s\"')\]”’]*$"
    return _c(text).rlike("[.!?…:;]" + closing) | _c(text).rlike("^" + closing)


def unfinished(word: Column | str) -> Column:
    """No mark that ends a sentence stands after the word's last letter or digit."""
    return ~_c(word).rlike(r"[.!?…:;][^\p{L}\p{Nd}.!?…:;]*$")


def continues_sentence(text: Column | str) -> Column:
    """The first letter or digit is a lower-case letter."""
    return F.regexp_extract(_c(text), r"[\p{L}\p{Nd}]", 0).rlike(r"\p{Ll}")


def continues_word(text: Column | str) -> Column:
    """The first letter, digits skipped, is lower case."""
    return F.regexp_extract(_c(text), r"\p{L}", 0).rlike(r"\p{Ll}")


def let(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def without_overlap(previous: Column | str, candidate: Column | str, most: int = 40) -> Column:
    """The candidate without the longest run of words at its start that repeats the end of the previous text."""

    def trimmed(s: Column) -> Column:
        after, a, b = s.getField("after"), s.getField("a"), s.getField("b")
        limit = F.least(F.lit(most), F.size(a), F.size(b))
        lengths = F.when(limit >= 1, F.sequence(limit, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
        found = F.get(F.filter(lengths, lambda n: F.slice(a, -n, n) == F.slice(b, F.lit(1), n)), F.lit(0))

        def rest(n: Column) -> Column:
            first = F.array_position(F.transform(F.slice(b, n + 1, F.size(b)), lambda w: w != ""), True).cast("int")
            return F.when(first > 0, F.array_join(F.slice(after, n + first, F.size(after)), " ")).otherwise("")

        return let(found, lambda n: F.when(n.isNull(), s.getField("text")).otherwise(rest(n)))

    split = F.struct(words(previous).alias("before"), words(candidate).alias("after"), _c(candidate).alias("text"))
    folded = let(split, lambda s: F.struct(s.getField("after").alias("after"), s.getField("text").alias("text"), F.transform(s.getField("before"), bare).alias("a"), F.transform(s.getField("after"), bare).alias("b")))
    return let(folded, trimmed)


def sentences(text: Column | str) -> Column:
    return F.filter(F.split(stripped(text), r"(?<=[.!?])\s+"), lambda s: ~blank(s))


def dialogue_parts(text: Column | str) -> Column:
    """Parts between dashes that open the text or stand between spaces."""
    parts = F.filter(F.transform(F.split(_c(text), "(?:^|(?<= ))-(?= )[- ]*"), stripped), lambda p: p != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(stripped(text)))


def occurrences(text: Column | str, query: str) -> Column:
    """How often the query stands in the text, case aside, without overlap."""
    lower = F.lower(_c(text))
    return F.when(F.lit(query) == "", 0).otherwise(((F.length(lower) - F.length(F.replace(lower, F.lit(query.lower()), F.lit("")))) / max(1, len(query))).cast("int"))


def clock(seconds: Column | str) -> Column:
    """m:ss, from an hour on h:mm:ss; parts of seconds are cut off."""
    s = F.floor(F.greatest(F.lit(0.0), _c(seconds)))
    return F.when(s >= 3600, F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)).otherwise(F.format_string("%d:%02d", F.floor(s / 60), s % 60))


def rounded_clock(seconds: Column | str) -> Column:
    """m:ss of seconds rounded half to even."""
    s = F.bround(F.greatest(F.lit(0.0), _c(seconds))).cast("long")
    return F.format_string("%d:%02d", F.floor(s / 60), s % 60)


def cue_time(seconds: Column | str) -> Column:
    """HH:MM:SS,mmm; parts of milliseconds are cut off."""
    ms = F.floor(F.floor(F.greatest(F.lit(0.0), _c(seconds)) * 1e7) / 1e4)
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def word_distance(left: Column, right: Column) -> Column:
    """The edit distance of two arrays of words: each distinct word becomes one character."""

    def written(words_: Column, known: Column) -> Column:
        code = lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(known, w) + 0x4DFF), 4, "0")), "UTF-16BE")
        return F.array_join(F.transform(words_, code), "")

    def distance(s: Column) -> Column:
        return F.levenshtein(written(s.getField("l"), s.getField("k")), written(s.getField("r"), s.getField("k")))

    both = let(F.struct(left.alias("l"), right.alias("r")), lambda s: s.withField("k", F.array_distinct(F.concat(s.getField("l"), s.getField("r")))))
    return let(both, distance)


def token_parts(token: Column | str) -> Column:
    """What stands before a word's letters and digits, these, and what follows, a possessive too: (prefix, core, suffix)."""
    token = _c(token)
    prefix = F.regexp_extract(token, rf"^({OTHER}*)", 1)

    def cut(s: Column) -> Column:
        core, rest = s.getField("core"), s.getField("rest")
        own = F.length(core) - F.when((F.length(core) > 2) & core.rlike("['’][sS]$"), 2).otherwise(0)
        return F.struct(s.getField("prefix").alias("prefix"), F.left(core, own).alias("core"), F.substring(rest, own + 1, F.length(rest)).alias("suffix"))

    inside = F.regexp_extract(token, rf"^{OTHER}*((?:.*[\p{{L}}\p{{Nd}}])?)", 1)
    whole = F.struct(prefix.alias("prefix"), inside.alias("core"), F.substring(token, F.length(prefix) + 1, F.length(token)).alias("rest"))
    return let(whole, cut)


def same_word(wanted: Column | str, actual: Column | str) -> Column:
    """Equal, or a wanted word begins with a small letter whose capital begins the actual one."""
    wanted, actual = _c(wanted), _c(actual)
    small, large = F.left(wanted, F.lit(1)), F.left(actual, F.lit(1))
    rest = lambda w: F.substring(w, F.lit(2), F.length(w))
    return (wanted == actual) | (small.rlike(r"\p{Ll}") & large.rlike(r"\p{Lu}") & (F.lower(large) == small) & (rest(wanted) == rest(actual)))


def words_around(text: Column | str, first: Column, stop: Column) -> Column:
    """The whole words that a selection from first up to stop touches, without the marks around them: (start, words); null if
    it touches none. A point at the very end is on the last character."""
    solid = r"[^\p{Z}\s]"

    def bounds(s: Column) -> Column:
        n = F.length(s.getField("text"))
        a = F.least(F.greatest(s.getField("first"), F.lit(0)), n)
        b = F.least(F.greatest(s.getField("stop"), a), n)
        last = (a == b) & (a == n) & (a > 0)
        a, b = F.when(last, a - 1).otherwise(a), F.when(last, a - 1).otherwise(b)
        return F.struct(s.getField("text").alias("text"), a.alias("a"), F.least(n, F.when(a == b, a + 1).otherwise(b)).alias("b"))

    def chosen(s: Column) -> Column:
        text = s.getField("text")
        start = F.length(F.regexp_replace(F.left(text, s.getField("a")), f"{solid}+\\z", ""))
        end = s.getField("b") + F.length(F.regexp_extract(F.substring(text, s.getField("b") + 1, F.length(text)), f"^({solid}*)", 1))
        return F.struct(start.alias("start"), F.substring(text, start + 1, end - start).alias("part"))

    def named(s: Column) -> Column:
        parts = F.transform(words(s.getField("part")), token_parts)
        cores = F.transform(parts, lambda x: x.getField("core"))
        at = s.getField("start") + F.length(F.regexp_extract(s.getField("part"), f"^({SPACE})?", 0)) + F.length(F.get(parts, F.lit(0)).getField("prefix"))
        return F.when(F.exists(cores, lambda c: c != ""), F.struct(at.alias("start"), F.array_join(cores, " ").alias("words")))

    return let(let(let(F.struct(_c(text).alias("text"), first.alias("first"), stop.alias("stop")), bounds), chosen), named)


def run_clock(seconds: Column | str) -> Column:
    """m:ss, from an hour on h:mm:ss, of seconds rounded half to even."""
    s = F.bround(F.greatest(F.lit(0.0), _c(seconds))).cast("long")
    return F.when(s >= 3600, F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)).otherwise(F.format_string("%d:%02d", F.floor(s / 60), s % 60))


def headline(total: Column | str, audio: Column | str) -> Column:
    """How long a run took, and for how long a recording."""
    done = F.concat(F.lit("Done in "), run_clock(total))
    return F.when(_c(audio) > 0, F.concat(done, F.lit(" for "), run_clock(audio), F.lit(" of audio."))).otherwise(F.concat(done, F.lit(".")))


def described(total: Column | str, audio: Column | str, steps: Column, least: float = 0.5) -> Column:
    """The headline and the steps (label, seconds) that took long enough to be named."""
    named = F.transform(F.filter(steps, lambda x: x.getField("seconds") >= least), lambda x: F.concat_ws(" ", x.getField("label"), run_clock(x.getField("seconds"))))
    return F.when(F.size(named) > 0, F.concat(headline(total, audio), F.lit(" "), F.array_join(named, " · "), F.lit("."))).otherwise(headline(total, audio))
