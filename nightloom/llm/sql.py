"""SQL of the add-on's queries that SQL can express at full size."""

from __future__ import annotations

import unicodedata

from ..plans import base
from .lookalike import folded

_RUNS = (
    base.SQL
    + """, x AS (SELECT *, epoch - row_number() OVER (PARTITION BY session_id, scorer, code ORDER BY epoch) AS g FROM one WHERE code IS NOT NULL),
r AS (SELECT session_id, scorer, min(epoch)::INT AS first_epoch, code, count(*)::INT AS n FROM x GROUP BY session_id, scorer, code, g)
SELECT r.session_id, r.scorer, first_epoch, label AS stage, n AS n_epochs, round_even(n * freq_sec, 0)::INT AS duration_s FROM r JOIN ses USING (session_id, scorer) JOIN lab ON lab.n_stages = ses.n_stages AND lab.code = r.code"""
)



def _folding(text: str) -> str:
    """SQL of a text with every character that prints like another as that one, outside Hangul and the ideographs."""
    one, gone, several = {}, [], {}
    for p in (*range(1, 0x3000), *range(0xFB00, 0xFB50), *range(0xFE00, 0xFE10), *range(0xFE60, 0xFF70), *range(0xFFE0, 0xFFF0)):
        ch = chr(p)
        if unicodedata.category(ch) in ("Cn", "Co", "Cs") or (to := unicodedata.normalize("NFC", folded(ch))) == ch:
            continue
        if not to:
            gone.append(ch)
        elif len(to) == 1:
            one[ch] = to
        else:
            several[ch] = to
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    text = f"replace(replace({text}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    for ch, to in several.items():
        text = f"replace({text}, {quoted(ch)}, {quoted(to)})"
    return f"nfc_normalize(translate(nfc_normalize({text}), {quoted(''.join(one) + ''.join(gone))}, {quoted(''.join(one.values()))}))"


#: Texts folded and composed, compared by their digests.
_LOOKS = f"""WITH k AS (SELECT doc_id, text, md5({_folding("text")}) AS look FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL))
"""

SQL = {
    "p8_found": _LOOKS + "SELECT DISTINCT least(a.doc_id, b.doc_id) AS doc_id_a, greatest(a.doc_id, b.doc_id) AS doc_id_b FROM k a JOIN k b ON a.look = b.look AND a.text < b.text AND a.doc_id <> b.doc_id",
    "p8_classes": _LOOKS + ", g AS (SELECT look, count(*) AS n, min(doc_id) AS first FROM k GROUP BY look), w AS (SELECT look, text, count(*) AS same FROM k GROUP BY ALL) SELECT doc_id, first AS class_id, n::BIGINT AS n_members, (n - same)::BIGINT AS n_links FROM k JOIN g USING (look) JOIN w ON w.look = k.look AND w.text = k.text",
    "p5_runs": _RUNS,
    "p5_found": _RUNS + " WHERE n >= 2",
    "p4_found": """WITH sw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY loaded_at DESC) AS rn FROM sw_event) WHERE rn = 1),
sp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY loaded_at DESC) AS rn FROM spindle_event) WHERE rn = 1),
j AS (SELECT sw.event_id AS sw_id, sp.event_id AS spindle_id, row_number() OVER (PARTITION BY sw.event_id ORDER BY abs(round(sp.start * 1e6) - round(negpeak * 1e6)), sp.start, sp.event_id) AS k
 FROM sw JOIN sp USING (recording_id, channel) WHERE abs(round(sp.start * 1e6) - round(negpeak * 1e6)) <= 1200000)
SELECT sw_id, spindle_id FROM j WHERE k = 1""",
}
