"""Normalising, hashing and checking of change text and names."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Fixed value: the code points that count as white space at the edges of a body.
WHITE_SPACE = "".join(
    chr(point)
    for point in (
        *range(0x0009, 0x000E), 0x0020, 0x0085, 0x00A0, 0x1680,
        *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    )
)

# The shapes of names and digests.
HASH_SHAPE = r"\A[0-9a-fA-F]{64}\z"
FILENAME_SHAPE = r"\A[0-9]{6}\.sql\z"
IDENTIFIER_SHAPE = r"\A[_A-Za-z][_A-Za-z0-9]*\z"
BINDING_NAME_SHAPE = r"\A[_A-Z][_A-Z0-9]*\z"
_DIGEST_SHAPE = r"\A[0-9a-f]{64}\z"
_DIGEST_BYTES = 32
# Stands before any other text where digests travel as bytes, so that it is longer than a digest.
_NO_DIGEST = bytes(_DIGEST_BYTES + 1)

# The hashes of a change; two thirds of a narrow row, and hexadecimal digits do not compress.
DIGESTS = ("hash", "previous_hash")


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` mentions it.

    Spark shares repeated expressions only where all of them are sure to be evaluated,
    which is not so inside ``when`` or a lambda.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trim_space(column: Column | str) -> Column:
    """Strip Unicode white space from both ends (Spark's plain ``trim`` strips spaces only)."""
    return F.btrim(_col(column), F.lit(WHITE_SPACE))


def to_lf(column: Column | str) -> Column:
    """CRLF line ends become LF."""
    return F.replace(_col(column), F.lit("\r\n"), F.lit("\n"))


def normalize(column: Column | str) -> Column:
    """Trimmed text with exactly one final line break; blank text becomes empty."""
    trimmed = trim_space(column)
    return F.concat(trimmed, F.when(trimmed == "", "").otherwise("\n"))


def has_changes(column: Column | str) -> Column:
    """True when something other than white space is there."""
    return trim_space(column) != ""


def link_hash(previous: Column | str, body: Column | str) -> Column:
    """SHA-256 over the previous hash (or nothing), a line break and the normalised body."""
    return F.sha2(F.concat(F.coalesce(_col(previous), F.lit("")), F.lit("\n"), normalize(body)), 256)


def hash_matches(previous: Column | str, recorded: Column | str, body: Column | str) -> Column:
    """True when the recorded hash is the one the row's content gives; hex case is ignored."""
    expected = link_hash(F.lower(_col(previous)), body)
    return F.coalesce(F.lower(_col(recorded)) == expected, F.lit(False))


def is_valid_hash(column: Column | str) -> Column:
    return _col(column).rlike(HASH_SHAPE)


def packed(df: DataFrame, columns: Sequence[str] = DIGESTS) -> DataFrame:
    """``df`` with digests as their 32 bytes, half of what the digits take in a shuffle.

    Any other text becomes longer bytes, so packed values are equal where the texts are, and ``unpacked`` gives every text back.
    """
    def pack(text: Column) -> Column:
        return F.when(text.rlike(_DIGEST_SHAPE), F.unhex(text)).otherwise(F.concat(F.lit(_NO_DIGEST), text.cast("binary")))

    return df.withColumns({c: pack(F.col(c)) for c in columns})


def unpacked(df: DataFrame, columns: Sequence[str] = DIGESTS) -> DataFrame:
    """The texts that ``packed`` was given."""
    def unpack(data: Column) -> Column:
        other = F.substring(data, len(_NO_DIGEST) + 1, 2**31 - 1).cast("string")
        return F.when(F.length(data) == _DIGEST_BYTES, F.lower(F.hex(data))).otherwise(other)

    return df.withColumns({c: unpack(F.col(c)) for c in columns})


def parse_version(filename: Column | str) -> Column:
    """The number in ``NNNNNN.sql``; null for any other name."""
    name = _col(filename)
    return F.when(name.rlike(FILENAME_SHAPE), F.substring(name, 1, 6).try_cast("int"))


def version_filename(version: Column | str) -> Column:
    """``NNNNNN.sql``. A number with more than six digits ends the job with E37, never in a shorter name."""
    number = _col(version)
    too_long = F.raise_error(F.concat(F.lit("E37 sequence limit reached: "), number.cast("string")))
    return F.when(number > 999_999, too_long.cast("string")).otherwise(
        F.concat(F.lpad(number.cast("string"), 6, "0"), F.lit(".sql"))
    )


def is_identifier(column: Column | str) -> Column:
    return _col(column).rlike(IDENTIFIER_SHAPE)


def quote_ident(column: Column | str) -> Column:
    return F.concat(F.lit('"'), F.replace(_col(column), F.lit('"'), F.lit('""')), F.lit('"'))


def is_binding_name(column: Column | str) -> Column:
    return _col(column).rlike(BINDING_NAME_SHAPE)


def status_code(pending: Column | str, changed: Column | str) -> Column:
    """1 for pending changes, 2 for a candidate with changes, 3 for both."""
    return _col(pending).cast("int").bitwiseOR(_col(changed).cast("int") * 2)
