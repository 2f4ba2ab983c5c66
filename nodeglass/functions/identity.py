"""Device identity carried in the user agent."""

from pyspark.sql import functions as F

# Whitespace as the usual text libraries see it: Unicode spaces and the four
# ASCII separators.
_SPACE = r"\s\x1c-\x1f"
_LAST_WORD = rf"(?sU)^(?:.*[{_SPACE}])?([^{_SPACE}]+)[{_SPACE}]*$"
_OUTER_SPACE = rf"(?U)^[{_SPACE}]+|[{_SPACE}]+$"

# A lenient Base64 reading: ASCII letters outside the alphabet are skipped,
# padding where a group has not reached two letters is skipped, and complete
# padding ends the text. What is left must be whole groups, and nothing beyond
# ASCII may be in the word, or it is not Base64. At most one reading fits, so
# the groups need no way back.
_SKIPPED = r"[\x00-\x7F&&[^A-Za-z0-9+/=]]"
_CHAR = "[A-Za-z0-9+/]"
_GROUP = f"=*{_CHAR}=*{_CHAR}=?{_CHAR}{_CHAR}"
_LAST_GROUP = f"=*{_CHAR}=*{_CHAR}==|=*{_CHAR}=*{_CHAR}=?{_CHAR}=|=*$"
_BASE64 = rf"^(?=[\x00-\x7F]*+$)((?:{_GROUP})*+(?:{_LAST_GROUP}))"


def _found(text, pattern):
    """First group of the pattern's only match, null without one."""
    return F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(0))


def decode_serial_number(user_agent):
    """Serial number in the last word of ``user_agent``.

    The word is Base64 over UTF-8. When it cannot be decoded the word itself is
    the answer; a blank user agent has no serial and gives null.

    Every step takes the one before it once, as Spark works out an expression
    again wherever it is named.
    """
    ua = F.col(user_agent) if isinstance(user_agent, str) else user_agent
    word = _found(ua, _LAST_WORD)
    fitting = _found(F.regexp_replace(word, _SKIPPED, ""), _BASE64)
    body = F.replace(fitting, F.lit("="), F.lit(""))
    # Padding is added in excess and cut to whole groups of four.
    padded = F.regexp_extract(F.concat(body, F.lit("===")), "^(?:.{4})*+", 0)
    text = F.try_validate_utf8(F.unbase64(padded).cast("string"))
    return F.coalesce(F.regexp_replace(text, _OUTER_SPACE, ""), word)
