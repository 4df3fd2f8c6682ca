"""SQL that states names without accents in any script: DuckDB decomposes no compatibility forms, so the rule is spelled out.

The table of characters is made here from the Unicode decompositions of the standard library.
"""

from __future__ import annotations

import sys
import unicodedata


def _bare(ch: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x))


_HANGUL = range(0xAC00, 0xAC00 + 11_172)
_CHANGED = [chr(c) for c in range(0x80, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and c not in _HANGUL and _bare(chr(c)) != chr(c)]
_BLANKS = "".join(f"\\x{{{c:X}}}" for c in range(sys.maxunicode + 1) if chr(c).isspace())


def trimmed(x: str) -> str:
    """Without white space of any script at both ends."""
    return f"regexp_replace({x}, '^[{_BLANKS}]+|[{_BLANKS}]+$', '', 'g')"


def concept(x: str) -> str:
    """The concept text of a name without outer blanks and accents."""
    return f"trim(regexp_replace(lower(regexp_replace(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'), '\\s*\\([^()]*\\)\\s*$', '')), '[^a-z0-9]+', ' ', 'g'))"


#: CTEs ``bare``: (alarme, aparado, solto, cru_solto) of every distinct name of tel, null among them.
BARE = f"""
cm AS (SELECT unnest(string_split('{chr(31).join(_CHANGED)}', '{chr(31)}')) AS f, unnest(string_split('{chr(31).join(_bare(c).replace("'", "''") for c in _CHANGED)}', '{chr(31)}')) AS t),
nm AS (SELECT DISTINCT alarme, {trimmed("alarme")} AS aparado FROM tel),
ns AS (SELECT alarme AS s FROM nm WHERE alarme IS NOT NULL UNION SELECT aparado FROM nm WHERE aparado IS NOT NULL),
nc AS (SELECT s, i, substring(s, CAST(i AS BIGINT), 1) AS c FROM (SELECT s, unnest(range(1, length(s) + 1)) AS i FROM ns)),
nt AS (SELECT s, string_agg(CASE WHEN unicode(c) BETWEEN {_HANGUL[0]} AND {_HANGUL[-1]} THEN chr(4352 + (unicode(c) - {_HANGUL[0]}) // 588) || chr(4449 + (unicode(c) - {_HANGUL[0]}) % 588 // 28) || CASE WHEN (unicode(c) - {_HANGUL[0]}) % 28 > 0 THEN chr(4519 + (unicode(c) - {_HANGUL[0]}) % 28) ELSE '' END
  ELSE coalesce(t, c) END, '' ORDER BY i) AS b FROM nc LEFT JOIN cm ON c = f GROUP BY 1),
bare AS (SELECT nm.alarme, nm.aparado, CASE WHEN nm.aparado = '' THEN '' ELSE x.b END AS solto, CASE WHEN nm.alarme = '' THEN '' ELSE y.b END AS cru_solto FROM nm LEFT JOIN nt x ON x.s = nm.aparado LEFT JOIN nt y ON y.s = nm.alarme)"""
