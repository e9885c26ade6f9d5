"""Text columns: cleaning, sentence splitting, packing, overlap, names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# The characters Python's str.strip() removes.
STRIP_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Fixed value: Python's \w as a Java character class.
WORD_CLASS = r"[\p{L}\p{N}_]"
# Abbreviations that do not end a sentence.
ABBREVIATIONS = ("Mr", "Mrs", "Dr", "St", "Jr", "Sr", "Gen", "vs", "No")

# Two marks for work inside an expression, from the Unicode noncharacters. A text may hold them all
# the same: there others that it does not hold stand in for them (`free_of_marks`).
KEEP = "\ufdd0"
BREAK = "\ufdd1"
STAND_INS = [chr(c) for c in range(0xFDD2, 0xFDF0)] + [chr(p << 16 | c) for p in range(1, 17) for c in (0xFFFE, 0xFFFF)]

GUARD_PATTERN = rf"(^|[ ({KEEP}])(\p{{Lu}}|{'|'.join(ABBREVIATIONS)})\. "
BREAK_PATTERN = r"""([.!?]["')\]]*) +(["'(\[]?\p{Lu})"""


def strip(col: Column) -> Column:
    """Python's `str.strip()`."""
    return F.trim(col, F.lit(STRIP_CHARS))


def clean_text(col: Column) -> Column:
    """Line breaks to single spaces, one for one, then `strip`."""
    return strip(F.translate(col, "\n\r", "  "))


def mark_sentences(col: Column) -> Column:
    """A cleaned text with BREAK in place of the blanks between sentences: a break follows end
    punctuation and precedes a capital, unless the punctuation belongs to an initial or an
    abbreviation."""
    guard = rf"$1$2.{KEEP}"
    # Twice, because a match takes the space that the next initial has to be preceded by.
    guarded = F.regexp_replace(F.regexp_replace(col, GUARD_PATTERN, guard), GUARD_PATTERN, guard)
    return F.translate(F.regexp_replace(guarded, BREAK_PATTERN, rf"$1{BREAK}$2"), KEEP, " ")


def stand_ins(text: Column) -> Column:
    """Two characters, in place of KEEP and BREAK, that the text does not hold: noncharacters, or for a text
    that has all but one of these, from the private planes. Only in a text that has those, too, do its own
    marks count as marks."""
    held = F.split(text, "")
    spare = F.slice(F.array_except(F.array(*map(F.lit, STAND_INS)), held), F.lit(1), F.lit(2))
    # The end depends on the text for the optimizer's sake, which would else write the array out in every plan.
    last = F.lit(0x10FFFD) + F.least(F.length(text), F.lit(0))
    private = F.transform(F.sequence(F.lit(0xF0000), last), lambda c: F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32"))
    more = F.slice(F.array_except(private, held), F.lit(1), F.lit(2))
    return F.when(F.size(spare) == 2, F.array_join(spare, "")).otherwise(
        F.when(F.size(more) == 2, F.array_join(more, "")).otherwise(F.lit(KEEP + BREAK)))


def swap(text: Column, old: Column, new: Column) -> Column:
    return F.call_function("translate", text, old, new)


def free_of_marks(text: Column, work: Callable[[Column], Column]) -> Column:
    """`work(text)`, an array of strings, with the text's own mark characters kept: each is replaced,
    one for one, by a character the text does not hold, and put back in the pieces. Refers to `text`
    more than once: pass a column."""
    marks, stand = F.lit(KEEP + BREAK), stand_ins(text)
    back = F.transform(work(swap(text, marks, stand)), lambda c: swap(c, stand, marks))
    return F.when(text.rlike(f"[{KEEP}{BREAK}]"), back).otherwise(work(text))


def split_sentences(col: Column) -> Column:
    """Sentences of a cleaned text; an empty text has none."""
    return free_of_marks(col, lambda t: F.array_remove(F.split(mark_sentences(t), BREAK), ""))


def pack_marked(marked: Column, chunk_size: int = 500) -> Column:
    """Greedy packing: a sentence joins the open chunk when it still fits with one space between;
    otherwise it opens the next chunk, however long it is.

    As the one-character mark stands for that space, the chunks are what one pattern matches: the
    longest run of at most `chunk_size` characters that ends at a mark, else one whole sentence.
    The time is linear in the text, for books too.
    """
    chunk = rf"(?s)\G(.{{1,{chunk_size}}}(?={BREAK}|\z)|[^{BREAK}]+){BREAK}?"
    chunks = F.regexp_extract_all(marked, F.lit(chunk), F.lit(1))
    return F.transform(chunks, lambda c: F.translate(c, BREAK, " "))


def pack_text(clean: Column, chunk_size: int = 500) -> Column:
    """Chunks of a cleaned text: its sentences, packed. Pass a column."""
    return free_of_marks(clean, lambda t: pack_marked(mark_sentences(t), chunk_size))


def pack_sentences(sentences: Column, chunk_size: int = 500) -> Column:
    """`pack_marked` of sentences that are an array already. Pass a column."""
    whole, marks = F.array_join(sentences, ""), F.lit(KEEP + BREAK)
    stand = stand_ins(whole)

    def packed(items: Column) -> Column:
        return pack_marked(F.array_join(F.array_remove(items, ""), BREAK), chunk_size)

    hidden = F.transform(sentences, lambda s: swap(s, marks, stand))
    back = F.transform(packed(hidden), lambda c: swap(c, stand, marks))
    return F.when(whole.rlike(f"[{KEEP}{BREAK}]"), back).otherwise(packed(sentences))


def with_previous(items: Column) -> Column:
    """`array<struct<prev, base>>`: each item next to the one before it (null before the first).

    Refers to `items` more than once: pass a column, not a costly expression.
    """
    prev = F.slice(F.concat(F.array(F.lit(None).cast("string")), items), F.lit(1), F.size(items))
    return F.arrays_zip(prev.alias("prev"), items.alias("base"))


def overlap_tail(text: Column, min_len: int) -> Column:
    """Last `min_len` characters, extended left to the start of the word they begin in."""
    tail = F.right(text, F.lit(min_len))
    # Reversed, the rest of the word is anchored at the start: one linear look at any length.
    head = F.reverse(F.substring(text, F.lit(1), F.length(text) - min_len))
    rest = F.reverse(F.regexp_extract(head, f"^{WORD_CLASS}*", 0))
    return (
        F.when(F.length(text) <= min_len, text)
        .when(tail.rlike(f"^{WORD_CLASS}"), F.concat(rest, tail))
        .otherwise(tail)
    )


def chunk_overlap_text(prev: Column, chunk_overlap: int) -> Column:
    """Text a chunk repeats from `prev`, the chunk before it (null for the first chunk)."""
    if chunk_overlap == 0:
        return F.lit("")
    return F.coalesce(overlap_tail(prev, chunk_overlap), F.lit(""))


# The separators of the recursive split, in the order they are tried.
SEPARATORS = ("\n\n", "\n", ".")


def recursive_pieces(text: Column, chunk_size: int = 500, separators: tuple[str, ...] = SEPARATORS) -> Column:
    """Chunks from splitting at the first separator, then only the too-long pieces at the next.

    A separator stays at the front of the piece after it. Pieces shorter than `chunk_size` are
    joined again up to `chunk_size`, stripped, and dropped when blank; a piece still too long
    after the last separator is kept as it is.
    """
    none = F.array().cast("array<string>")

    def level(part: Column, rest: tuple[str, ...]) -> Column:
        separator, deeper = rest[0], rest[1:]
        # The mark takes the place of the separator's first character, so lengths stay true.
        marked = F.replace(part, F.lit(separator), F.lit(BREAK + separator[1:]))
        # From one piece start to another: a piece that is too long, or the longest run that fits.
        run = rf"(?s)\G(.[^{BREAK}]{{{chunk_size - 1},}}|.{{1,{chunk_size}}}(?={BREAK}|\z))"

        def finish(found: Column) -> Column:
            one_piece = ~F.contains(F.substring(found, 2, 2**31 - 1), F.lit(BREAK))
            whole = F.translate(found, BREAK, separator[0])
            longer = level(whole, deeper) if deeper else F.array(whole)
            return (
                F.when((F.length(found) >= chunk_size) & one_piece, longer)
                .when(strip(whole) != "", F.array(strip(whole))).otherwise(none)
            )

        return F.flatten(F.transform(F.regexp_extract_all(marked, F.lit(run), F.lit(1)), finish))

    return free_of_marks(text, lambda t: level(t, separators))


def words(text: Column) -> Column:
    """Non-empty tokens between blanks, tabs and line breaks."""
    return F.array_remove(F.split(F.translate(text, "\n\r\t", "   "), " "), "")


def strip_suffix_everywhere(name: Column, suffix: str) -> Column:
    """`name` without any occurrence of `suffix` (file name to model name)."""
    return F.replace(name, F.lit(suffix), F.lit(""))


# Fixed value: scheme, authority and path of a URI (RFC 3986, appendix B); group 1 is the path.
URL_PATTERN = r"^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)"


def url_file_name(url: Column) -> Column:
    """Last segment of a URL's path, without `;parameters`; empty when there is no path."""
    last = F.substring_index(F.regexp_extract(url, URL_PATTERN, 1), "/", -1)
    return F.substring_index(last, ";", 1)
