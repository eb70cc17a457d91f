"""The same results as plain SQL over the given tables, for a checking engine."""

from __future__ import annotations

from reviewlens.functions import patterns as pt
from reviewlens.plans import derived as dv
from reviewlens.plans import formulas
from reviewlens.plans.queries import BEGINNINGS, HASHED, PHRASE_THRESHOLD, SEGMENT
from reviewlens.schema import ANNOTATION_ASPECTS, ASPECTS, SENTIMENTS

_K = range(len(ASPECTS))


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sub(text: str, pattern: str, to: str) -> str:
    return f"regexp_replace({text}, {_lit(pattern)}, {_lit(to)}, 'g')"


def _fold(text: str, rules) -> str:
    for written, wanted in rules:
        text = f"replace({text}, {_lit(written)}, {_lit(wanted)})"
    return text


# Written out here, apart from the library, for the kinds of emoji that the texts hold: flags, keycaps, and signs with
# a variation selector, skin tones or joiners.
_SIGN = r"[©®\x{2600}-\x{27BF}\x{1F300}-\x{1FAFF}]"
_EMOJI = (
    r"[\x{1F1E6}-\x{1F1FF}]|" + rf"{_SIGN}(?:\x{{FE0F}}|[\x{{1F3FB}}-\x{{1F3FF}}])?(?:\x{{200D}}{_SIGN}(?:\x{{FE0F}})?)*"
    r"|[#*0-9]\x{FE0F}?\x{20E3}"
)
_HASHTAG = r"#[^\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_PRICE = r"\p{Nd}+(?:[,.]\p{Nd}+)*[,.]?[ ]?(?:nghìn đồng|đồng|vnd|k|d|đ)"
_TRAINING_SIGNS = r"""["#$%&'()*+,\-/\\:;<=>@\[\]^_`{|}~\n\r\t]"""
_ANNOTATION_SIGNS = r"""["#$%&'()*+,\-./\\:;<=>@\[\]^_`{|}~\n\r\t]"""
# The queries' acronyms, the spelling rules and the last rule, in the order in which they are carried out.
_SPELLING = [
    ("kks", "khách sạn"), ("pour", "pour que"), ("nvp", "nhân viên phục vụ"), ("oà ", "òa "), ("oá ", "óa "), ("oả ", "ỏa "),
    ("oã ", "õa "), ("oạ ", "ọa "), ("oè", "òe"), ("oé", "óe"), ("oẻ", "ỏe"), ("oẽ", "õe"),
    ("oẹ", "ọe"), ("uỳ", "ùy"), ("uý", "úy"), ("uỷ", "ủy"), ("uỹ", "ũy"), ("uỵ", "ụy"),
    ("uà", "ùa"), ("uá ", "úa "), ("uả", "ủa"), ("uã", "ũa"), ("uạ", "ụa"), ("xẩy", "xảy"),
    ("bẩy", "bảy"), ("gẫy", "gãy"), ("nvien", "nhân viên "), ("qay", "quay"), ("ìnhh", "ình"),
]


def _emoji(text: str) -> str:
    return _sub(text, _EMOJI, "")


def _spelling(text: str) -> str:
    return _fold(text, _SPELLING)


def _special(text: str, signs: str = _TRAINING_SIGNS, to: str = " ") -> str:
    return _sub(text, signs, to)


def _autocorrect(text: str) -> str:
    """Keywords are marked in one pass, then replaced. RE2's word boundary is the ASCII one."""
    plain = "|".join(k for k, _ in pt.KEYWORDS if k[-1].isascii())
    accented = "|".join(k for k, _ in pt.KEYWORDS if not k[-1].isascii())
    marked = (
        f"regexp_replace({text}, {_lit(rf'\b(?:{plain})\b|\b(?:{accented})\B')}, "
        r"chr(64976) || '\0' || chr(64977), 'g')"
    )
    for written, wanted in pt.KEYWORDS:
        marked = f"replace({marked}, chr(64976) || {_lit(written)} || chr(64977), {_lit(wanted)})"
    return marked


def _basic(text: str) -> str:
    return _special(_emoji(f"lower(nfc_normalize({text}))"))


def _advanced(text: str) -> str:
    text = _sub(_emoji(f"lower(nfc_normalize({text}))"), _HASHTAG, "HASTAG")
    return _special(_spelling(_sub(text, _PRICE, "PRICE")))


def _base(text: str) -> str:
    return f"nfc_normalize({_emoji(f'lower({text})')})"


def _annotation(text: str) -> str:
    text = _sub(_sub(_autocorrect(_base(text)), _PRICE, "giá_tiền"), _HASHTAG, "hashtag")
    return _special(text, _ANNOTATION_SIGNS, "")


def _q(name: str) -> str:
    return f'"{name}"'


_TEXTS = f"texts AS (SELECT doc_id, {dv.CMT} AS cmt FROM documents)"
_REVIEWS = (
    f"reviews AS (SELECT doc_id, {dv.CMT} AS cmt, "
    + ", ".join(f"{sql} AS {_q(a)}" for a, sql in dv.LABELS.items())
    + " FROM documents LEFT JOIN labels USING (doc_id))"
)


def _value(a: str) -> str:
    """Label text as the training number."""
    return f"CASE WHEN {a} IN ('-1.0', '0.0', '1.0') THEN CAST({a} AS FLOAT) ELSE CAST(-2 AS FLOAT) END"


def _codes(reader: str) -> str:
    cols = ", ".join(f"{dv.code_sql(reader, a)} AS c{j}" for j, a in enumerate(ASPECTS))
    return f"{reader} AS (SELECT doc_id, {cols} FROM reviews)"


_READERS = "WITH " + ", ".join([_REVIEWS, *[_codes(r) for r in dv.READERS]])
_NAMES = [f"CASE c{j} WHEN 1 THEN 'negative' WHEN 2 THEN 'neutral' WHEN 3 THEN 'positive' END" for j in _K]
_SENTIMENT_COLUMNS = ", ".join(f"{n} AS {_q(a)}" for n, a in zip(_NAMES, ANNOTATION_ASPECTS, strict=True))
_LABEL_TEXT = (
    "concat_ws(', ', "
    + ", ".join(f"'{{{a}, ' || {n} || '}}'" for n, a in zip(_NAMES, ANNOTATION_ASPECTS, strict=True))
    + ")"
)
_PREDICTIONS = (
    f"WITH {_REVIEWS}, parsed AS (SELECT doc_id, "
    + ", ".join(f"{_value(a)} AS {_q(a)}" for a in ASPECTS)
    + " FROM reviews), guesses AS (SELECT doc_id, "
    + ", ".join(f"{_q(a)} AS l{j}, {dv.PREDICTION.format(a=a, k=j + 3)} AS p{j}" for j, a in enumerate(ASPECTS))
    + " FROM parsed)"
)


def _snap(p: str) -> str:
    return (
        f"CAST(CASE WHEN {p} <= -1.5 THEN -2 WHEN {p} < -0.5 THEN -1 WHEN {p} <= 0.5 THEN 0 ELSE 1 END AS FLOAT)"
    )


def _accuracy(guess: str, overall: bool, source: str = _PREDICTIONS) -> str:
    each = " UNION ALL ".join(
        f"SELECT '{a}' AS aspect, CAST(sum(CASE WHEN l{j} = {guess.format(j=j)} THEN 1 ELSE 0 END) AS BIGINT) "
        f"AS correct, count(*) AS total FROM guesses"
        for j, a in enumerate(ASPECTS)
    )
    every = (
        " UNION ALL SELECT 'overall', CAST(sum(correct) AS BIGINT), CAST(sum(total) AS BIGINT) FROM each"
        if overall else ""
    )
    return (
        f"{source}, each AS ({each}), rows AS (SELECT * FROM each{every}) "
        "SELECT aspect, correct, total, round(correct / CAST(total AS DOUBLE), 9) AS accuracy FROM rows"
    )


def _pairs(true: str, pred: str, aspects=_K) -> str:
    """Long rows (rec, aspect number, t, p) of two readers."""
    return "pairs AS (" + " UNION ALL ".join(
        f"SELECT t.doc_id AS rec, {j} AS j, t.c{j} AS t, p.c{j} AS p FROM {true} t JOIN {pred} p USING (doc_id)"
        for j in aspects
    ) + ")"


_SUMS = (
    "sum(CASE WHEN t <> 0 AND t = p THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN t <> 0 THEN 1 ELSE 0 END) AS tn, "
    "sum(CASE WHEN p <> 0 THEN 1 ELSE 0 END) AS pn"
)
_F1 = "CASE WHEN tn + pn = 0 THEN CAST(0 AS DOUBLE) ELSE 2 * tp / CAST(tn + pn AS DOUBLE) END"


def _micro(true: str, pred: str, aspects=_K) -> str:
    return f"{_READERS}, {_pairs(true, pred, aspects)} SELECT round({_F1}, 9) AS f1 FROM (SELECT {_SUMS} FROM pairs)"


_CLASSES = (
    f"{_READERS}, {_pairs('gold', 'a2')}, classes AS (SELECT j, c, "
    "sum(CASE WHEN t = c AND p = c THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN t = c THEN 1 ELSE 0 END) AS tn, "
    "sum(CASE WHEN p = c THEN 1 ELSE 0 END) AS pn "
    "FROM pairs, (SELECT unnest([1, 2, 3]) AS c) GROUP BY j, c)"
)

_BLANKS = r"[ \t\n\x0B\f\r]"
_WORDS = (
    f"WITH {_TEXTS}, cleaned AS (SELECT doc_id, {_basic('cmt')} AS cmt FROM texts), "
    "trimmed AS (SELECT doc_id, cmt, rtrim(cmt, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM cleaned), "
    f"tokens AS (SELECT doc_id, unnest(CASE WHEN body = '' AND cmt <> '' THEN [] ELSE string_split_regex(body, {_lit(_BLANKS)}) END) AS term FROM trimmed), "
    "per_doc AS (SELECT doc_id, term, count(*) AS tf FROM tokens GROUP BY doc_id, term), "
    "stats AS (SELECT term, CAST(sum(tf) AS BIGINT) AS n, count(*) AS df FROM per_doc GROUP BY term)"
)
_PHRASES = (
    f"WITH {_TEXTS}, cleaned AS (SELECT doc_id, {_basic('cmt')} AS cmt FROM texts), "
    f"docs AS (SELECT doc_id, list_filter(string_split_regex(cmt, {_lit(_BLANKS + '+')}), lambda w: w <> '') AS words FROM cleaned), "
    "spots AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM docs), "
    "singles AS (SELECT words[i] AS w, count(*) AS n FROM spots GROUP BY 1), "
    "pairs AS (SELECT words[i] AS a, words[i + 1] AS b, count(*) AS n_ab FROM spots WHERE i < len(words) GROUP BY 1, 2), "
    "scored AS (SELECT a, b, n_ab, x.n AS n_a, y.n AS n_b, "
    "(n_ab - 5) * (SELECT CAST(sum(n) AS DOUBLE) FROM singles) / (CAST(x.n AS DOUBLE) * y.n) AS score "
    "FROM pairs JOIN singles x ON x.w = a JOIN singles y ON y.w = b), "
    f"found AS (SELECT * FROM scored WHERE score >= {PHRASE_THRESHOLD})"
)


def _grams(clean) -> str:
    return (
        f"WITH RECURSIVE {_TEXTS}, cleaned AS (SELECT doc_id, {clean('cmt')} AS cmt FROM texts), "
        f"docs AS (SELECT doc_id, list_filter(string_split_regex(cmt, {_lit(_BLANKS + '+')}), lambda w: w <> '') AS words FROM cleaned), "
        "spots AS (SELECT doc_id, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS i FROM docs), "
        "ends AS (SELECT *, regexp_matches(w, '[.!?]$') AS stop FROM spots), "
        "placed AS (SELECT doc_id, i, w, stop, coalesce(sum(stop::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM ends), "
        "next AS (SELECT *, " + ", ".join(f"lead(w, {k}) OVER (PARTITION BY doc_id, s ORDER BY i) AS w{k}" for k in (1, 2, 3))
        + ", row_number() OVER (PARTITION BY doc_id, s ORDER BY i) AS j, count(*) OVER (PARTITION BY doc_id, s) AS m FROM placed), "
        "grams AS (SELECT doc_id, s, j, m, w AS g1, w || '_' || w1 AS g2, w || '_' || w1 || '_' || w2 AS g3, w || '_' || w1 || '_' || w2 || '_' || w3 AS g4 FROM next), "
        "counts AS (SELECT word, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT g{k} AS word FROM grams WHERE g{k} IS NOT NULL" for k in (1, 2, 3, 4))
        + f") GROUP BY word HAVING count(*) >= {SEGMENT['least']}), "
        "total AS (SELECT CAST(sum(n) AS DOUBLE) AS t FROM counts WHERE NOT contains(word, '_')), "
        "lexicon AS (SELECT word, n, CAST(round((ln(t) - ln(CAST(n AS DOUBLE)) + "
        f"(length(word) - length(replace(word, '_', ''))) * ln(CAST({SEGMENT['threshold']} AS DOUBLE))) * 1000) AS BIGINT) AS cost FROM counts, total)"
    )


def _segments(clean) -> str:
    """Best costs from each place to the end of its sentence, from the right; then the way from the left."""
    return (
        f"{_grams(clean)}, edges AS (SELECT doc_id, s, j, m, g1, g2, g3, g4, coalesce(a.cost, 25000) AS c1, b.cost AS c2, c.cost AS c3, d.cost AS c4 FROM grams "
        "LEFT JOIN lexicon a ON a.word = g1 LEFT JOIN lexicon b ON b.word = g2 LEFT JOIN lexicon c ON c.word = g3 LEFT JOIN lexicon d ON d.word = g4), "
        "walk(doc_id, s, j, b1, b2, b3, b4, k, g) AS (SELECT DISTINCT doc_id, s, m + 1, 0, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, 0, '' FROM edges UNION ALL "
        "SELECT doc_id, s, j, least(t1, t2, t3, t4), b1, b2, b3, "
        "CASE least(t1, t2, t3, t4) WHEN t4 THEN 4 WHEN t3 THEN 3 WHEN t2 THEN 2 ELSE 1 END, "
        "CASE least(t1, t2, t3, t4) WHEN t4 THEN g4 WHEN t3 THEN g3 WHEN t2 THEN g2 ELSE g1 END FROM "
        "(SELECT e.*, b1, b2, b3, c1 + b1 AS t1, c2 + b2 AS t2, c3 + b3 AS t3, c4 + b4 AS t4 FROM walk w JOIN edges e ON e.doc_id = w.doc_id AND e.s = w.s AND e.j = w.j - 1)), "
        "way(doc_id, s, j, k, g) AS (SELECT doc_id, s, j, k, g FROM walk WHERE j = 1 UNION ALL "
        "SELECT w.doc_id, w.s, w.j, w.k, w.g FROM way y JOIN walk w ON w.doc_id = y.doc_id AND w.s = y.s AND w.j = y.j + y.k WHERE w.k > 0) "
        "SELECT doc_id, coalesce(cmt, '') AS cmt FROM documents LEFT JOIN (SELECT doc_id, string_agg(g, ' ' ORDER BY s, j) AS cmt FROM way GROUP BY doc_id) USING (doc_id)"
    )


def _fixed(arch: str, clean, table: str = "texts", kept: str = "doc_id") -> str:
    """CTEs that end in ``guesses`` (kept columns, p0 to p6): a fixed network over the word counts of ``table``'s cleaned cmt."""
    split = f"string_split_regex(lower(coalesce({clean('cmt')}, '')), {_lit(_BLANKS)})"
    counts = ", ".join(f"CAST(len(list_filter(ws, lambda w: w = {_lit(v)})) AS DOUBLE) AS x{i}" for i, v in enumerate(formulas.VOCABULARY))
    values = formulas.outputs(arch, formulas.model_weights(arch), [f"x{i}" for i in range(len(formulas.VOCABULARY))])
    return (
        f"worded AS (SELECT {kept}, {split} AS ws FROM {table}), counted AS (SELECT {kept}, {counts} FROM worded), "
        f"guesses AS (SELECT {kept}, " + ", ".join(f"{v} AS p{j}" for j, v in enumerate(values)) + " FROM counted)"
    )


def _sentence(p: str) -> str:
    return f"CASE WHEN {p} <= -1.5 THEN '' WHEN {p} < -0.5 THEN '-1.0' WHEN {p} <= 0.5 THEN '0.0' ELSE '1.0' END"


def _evaluated(arch: str, clean) -> str:
    values = ", ".join(f"{_value(a)} AS l{j}" for j, a in enumerate(ASPECTS))
    kept = ", ".join(f"l{j}" for j in _K)
    source = f"WITH {_REVIEWS}, valued AS (SELECT cmt, {values} FROM reviews), {_fixed(arch, clean, 'valued', kept)}"
    return _accuracy(_snap("p{j}"), True, source)


def _text(expression: str) -> str:
    return f"WITH {_TEXTS} SELECT doc_id, {expression} AS cmt FROM texts"


def _aspect_columns(make) -> str:
    return ", ".join(f"{make(j, a)} AS {_q(a)}" for j, a in enumerate(ASPECTS))


def _decoded(after: str) -> str:
    found = [f"regexp_extract_all(labels, '\\{{(.+?), ([a-z]+)\\}}', {g})" for g in (1, 2)]
    last = ", ".join(
        f"list_filter(list_zip({found[0]}, {found[1]}), lambda p: p[1] = '{a}')[-1][2] AS {_q(a)}"
        for a in ANNOTATION_ASPECTS
    )
    return f"{_READERS}, coded AS (SELECT doc_id AS id, {_LABEL_TEXT} || '{after}' AS labels FROM a1) SELECT id, {last} FROM coded"


def oracle_sql() -> dict[str, str]:
    out = {
        "nfc": _text("nfc_normalize(cmt)"),
        "lower_text": _text("lower(cmt)"),
        "remove_emoji": _text(_emoji("cmt")),
        "mask_hashtags": _text(_sub("cmt", _HASHTAG, "HASTAG")),
        "mask_prices": _text(_sub("cmt", _PRICE, "PRICE")),
        "spelling_rules": _text(_spelling("cmt")),
        "apply_rules": _text(_fold("cmt", dv.RULES)),
        "strip_special": _text(_special("cmt")),
        "autocorrect": _text(_autocorrect("lower(cmt)")),
        "mask_prices_annotation": _text(_sub("cmt", _PRICE, "giá_tiền")),
        "mask_hashtags_annotation": _text(_sub("cmt", _HASHTAG, "hashtag")),
        "delete_special": _text(_special("cmt", _ANNOTATION_SIGNS, "")),
        "clean_base": _text(_base("cmt")),
        "clean_basic": _text(_basic("cmt")),
        "clean_advanced": _text(_advanced("cmt")),
        "clean_annotation": _text(_annotation("cmt")),
        "clean_sentences": _text(_basic("cmt")),
    }
    out["read_reviews"] = f"WITH {_REVIEWS} SELECT doc_id, cmt, " + _aspect_columns(
        lambda j, a: f"nullif({a}, 'nan')"
    ) + " FROM reviews"
    out["read_reviews_split"] = out["read_reviews"]
    out["read_reviews_two_folders"] = f"WITH {_REVIEWS} SELECT doc_id, cmt, " + _aspect_columns(
        lambda j, a: f"nullif({a}, 'nan')"
    ) + " FROM reviews"
    cells = ", ".join(dv.ACRONYMS.values())
    out["large_dictionary"] = (
        f"WITH {_TEXTS}, words AS (SELECT unnest(string_split(text, ' ')) AS word FROM documents), "
        "found AS (SELECT word[1:5] AS src FROM words WHERE regexp_full_match(word, '[a-z]{6,}') GROUP BY 1 "
        f"HAVING count(*) >= {BEGINNINGS}), "
        "rules AS (SELECT list({'a': src, 'b': reverse(src[1:3]) || src[4:5]} ORDER BY src) AS held FROM found) "
        "SELECT doc_id, list_reduce(list_prepend({'a': cmt, 'b': ''}, coalesce(held, [])), "
        "lambda x, y: {'a': replace(x.a, y.a, y.b), 'b': ''}).a AS cmt FROM texts, rules"
    )
    out["acronym_rules"] = (
        f"WITH cells AS (SELECT p_partkey AS pos, list_filter([{cells}], lambda v: length(v) >= 3) AS c FROM part) "
        "SELECT min(pos) AS pos, arg_max(c[1], pos) AS src, c[2] AS dst FROM cells WHERE len(c) = 2 GROUP BY c[2]"
    )
    out["annotations_roundtrip"] = (
        f"{_READERS} SELECT 'a1' AS annotator, row_number() OVER (ORDER BY doc_id) - 1 AS rec, "
        f"{_annotation('r.cmt')} AS review, {_LABEL_TEXT} AS labels, {_SENTIMENT_COLUMNS} "
        "FROM a1 JOIN (SELECT doc_id, cmt FROM reviews) r USING (doc_id)"
    )
    out["annotations_csv"] = (
        f"{_READERS} SELECT doc_id AS id, r.cmt AS review, {_SENTIMENT_COLUMNS} "
        "FROM a1 JOIN (SELECT doc_id, cmt FROM reviews) r USING (doc_id)"
    )
    out["annotations_csv_unlabelled"] = f"SELECT doc_id AS id, {dv.CMT} AS review, " + ", ".join(
        f"CAST(NULL AS VARCHAR) AS {_q(a)}" for a in ANNOTATION_ASPECTS
    ) + " FROM documents"

    out["clean_reviews"] = f"WITH {_REVIEWS} SELECT doc_id, {_advanced('cmt')} AS cmt, " + _aspect_columns(
        lambda j, a: _value(a)
    ) + " FROM reviews"
    out["row_index"] = f'SELECT doc_id, {dv.CMT} AS cmt, row_number() OVER (ORDER BY doc_id) - 1 AS "ColumnIndex" FROM documents'
    out["document_at"] = (
        f"{_READERS} SELECT id, review, labels FROM (SELECT doc_id AS id, r.cmt AS review, {_LABEL_TEXT} AS labels, "
        "row_number() OVER (ORDER BY doc_id) - 1 AS place FROM a1 JOIN (SELECT doc_id, cmt FROM reviews) r USING (doc_id)) "
        "WHERE place = 42"
    )
    out["hash_split"] = (
        f"SELECT doc_id, {dv.CMT} AS cmt, CASE WHEN CAST('0x' || substr(md5('50:' || doc_id), 1, 8) AS BIGINT) % 1000 < 800 "
        "THEN 'train' ELSE 'test' END AS side FROM documents"
    )
    out["exact_split"] = (
        "WITH n AS (SELECT count(*) AS n, CAST(round_even(0.8 * count(*), 0) AS BIGINT) AS t FROM documents) "
        "SELECT 'train' AS side, t AS n_rows FROM n UNION ALL SELECT 'test', n - t FROM n"
    )
    out["parse_labels"] = f"WITH {_REVIEWS} SELECT doc_id, {_aspect_columns(lambda j, a: _value(a))} FROM reviews"
    out["label_array"] = out["parse_labels"]
    out["parse_labels_exact"] = (
        f"WITH {_REVIEWS}, bare AS (SELECT doc_id, "
        + _aspect_columns(lambda j, a: f"CASE WHEN doc_id % 2 = 0 THEN replace({a}, '.0', '') ELSE {a} END")
        + f" FROM reviews) SELECT doc_id, {_aspect_columns(lambda j, a: _value(a))} FROM bare"
    )
    out["snap_predictions"] = f"{_PREDICTIONS} SELECT doc_id, " + _aspect_columns(
        lambda j, a: _snap(f"p{j}")
    ) + " FROM guesses"
    out["blank_absent"] = f"{_PREDICTIONS} SELECT doc_id, " + _aspect_columns(
        lambda j, a: f"CASE WHEN p{j} <= -1.5 THEN '' WHEN p{j} < -0.5 THEN '-1.0' WHEN p{j} <= 0.5 THEN '0.0' ELSE '1.0' END"
    ) + " FROM guesses"
    out["code_sentiment"] = f"{_READERS} SELECT doc_id AS id, {_SENTIMENT_COLUMNS} FROM a2"
    out["sentiment_codes"] = f"{_READERS} SELECT doc_id AS id, " + ", ".join(
        f"c{j} AS {_q(a)}" for j, a in enumerate(ANNOTATION_ASPECTS)
    ) + " FROM gold"
    out["with_dne"] = f"{_READERS} SELECT doc_id AS id, " + ", ".join(
        f"coalesce({n}, 'dne') AS {_q(a)}" for n, a in zip(_NAMES, ANNOTATION_ASPECTS, strict=True)
    ) + " FROM a1"
    out["mentioned_aspects"] = f"{_READERS} " + " UNION ALL ".join(
        f"SELECT doc_id AS id, '{a}' AS aspect, {n} AS sentiment FROM a1 WHERE c{j} <> 0"
        for j, (n, a) in enumerate(zip(_NAMES, ANNOTATION_ASPECTS, strict=True))
    )
    out["multilabel"] = f"{_READERS} SELECT doc_id AS rec, " + ", ".join(
        f"c{j} = {c} AS m{3 * j + c - 1}" for j in _K for c in (1, 2, 3)
    ) + " FROM a2"
    out["encode_labels"] = f"{_READERS} SELECT doc_id AS id, {_LABEL_TEXT} AS labels FROM a1"
    out["decode_labels"] = _decoded(", {PRICE, neutral}")
    out["unknown_label_names"] = "SELECT doc_id AS id, 'PARKING' AS aspect FROM documents"
    out["to_training"] = f"{_READERS} SELECT doc_id AS id, " + _aspect_columns(
        lambda j, a: f"CAST(CASE c{j} WHEN 0 THEN -2 ELSE c{j} - 2 END AS FLOAT)"
    ) + " FROM gold"

    sentiments = ", ".join(_lit(s) for s in SENTIMENTS)
    aspects = ", ".join(_lit(a) for a in ANNOTATION_ASPECTS)
    out["apply_edits"] = (
        f"{_READERS}, edits AS (SELECT user_id % (SELECT count(*) FROM documents) AS id, "
        f"([{aspects}])[event_id % 7 + 1] AS aspect, ([{sentiments}])[(event_id // 7) % 4 + 1] AS sentiment, event_id AS seq FROM events), "
        "latest AS (SELECT id, aspect, arg_max(sentiment, seq) AS sentiment FROM edits GROUP BY id, aspect) "
        "SELECT doc_id AS id, " + ", ".join(
            f"CASE WHEN e{j}.sentiment IS NULL THEN {n} WHEN e{j}.sentiment = 'dne' THEN NULL ELSE e{j}.sentiment END AS {_q(a)}"
            for j, (n, a) in enumerate(zip(_NAMES, ANNOTATION_ASPECTS, strict=True))
        ) + " FROM a1 " + " ".join(
            f"LEFT JOIN latest e{j} ON e{j}.id = a1.doc_id AND e{j}.aspect = '{a}'"
            for j, a in enumerate(ANNOTATION_ASPECTS)
        )
    )
    out["align_mismatches"] = (
        "SELECT doc_id AS rec, CASE WHEN doc_id % 20 = 9 THEN 'not in a1' WHEN doc_id % 10 = 7 THEN 'not in a2' "
        "ELSE 'different review' END AS problem FROM documents WHERE doc_id % 20 = 9 OR doc_id % 10 IN (3, 7)"
    )
    out["agreement"] = _micro("a1", "a2")
    out["agreement_six"] = _micro("a1", "a2", range(1, 7))
    out["benchmark"] = " UNION ALL ".join(
        f"SELECT '{r}' AS annotator, f1 FROM ({_micro('gold', r)})" for r in ("a1", "a2")
    )
    out["compare_annotators"] = f"SELECT 'agreement' AS measure, f1 FROM ({_micro('a1', 'a2')}) UNION ALL " + " UNION ALL ".join(
        f"SELECT 'benchmark {r}', f1 FROM ({_micro('gold', r)})" for r in ("a1", "a2")
    )

    out["aspect_accuracy"] = _accuracy(_snap("p{j}"), False)
    out["accuracy_report"] = _accuracy(_snap("p{j}"), True)
    out["constant_accuracy"] = _accuracy("-2", True)
    out["multilabel_f1_micro"] = _micro("gold", "a2")
    out["multilabel_f1_macro"] = f"{_CLASSES} SELECT round(avg({_F1}), 9) AS f1 FROM classes"
    out["multilabel_f1_weighted"] = (
        f"{_CLASSES} SELECT round(sum({_F1} * tn) / CAST(sum(tn) AS DOUBLE), 9) AS f1 FROM classes"
    )
    out["multilabel_f1_samples"] = (
        f"{_READERS}, {_pairs('gold', 'a2')} SELECT round(avg({_F1}), 9) AS f1 FROM "
        f"(SELECT rec, {_SUMS} FROM pairs GROUP BY rec)"
    )
    out["f1_per_class"] = (
        f"{_CLASSES} SELECT ([{aspects}])[j + 1] AS aspect, ([{sentiments}])[c + 1] AS sentiment, "
        f"CAST(tp AS BIGINT) AS tp, CAST(tn AS BIGINT) AS true_n, CAST(pn AS BIGINT) AS pred_n, round({_F1}, 9) AS f1 FROM classes"
    )
    shares = " + ".join(
        f"(sum(CASE WHEN t = {c} THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE)) * "
        f"(sum(CASE WHEN p = {c} THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE))"
        for c in range(4)
    )
    out["cohen_kappa"] = (
        f"{_READERS}, {_pairs('a1', 'a2')}, levels AS (SELECT ([{aspects}])[j + 1] AS aspect, t, p FROM pairs "
        "UNION ALL SELECT 'ALL', t, p FROM pairs), "
        "parts AS (SELECT aspect, count(*) AS n, sum(CASE WHEN t = p THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS observed, "
        f"{shares} AS chance FROM levels GROUP BY aspect) "
        "SELECT aspect, n, round(observed, 9) AS observed, round(chance, 9) AS chance, "
        "round((observed - chance) / (1 - chance), 9) AS kappa FROM parts"
    )

    out["term_stats"] = f"{_WORDS} SELECT term, n, df FROM stats"
    out["vocabulary"] = (
        f"{_WORDS} SELECT CAST(row_number() OVER (ORDER BY n DESC, term) - 1 AS INTEGER) AS rank, term, n, df "
        "FROM stats WHERE df >= 5 ORDER BY n DESC, term LIMIT 500"
    )
    out["ranked_vocabulary"] = f"{_WORDS} SELECT term, n, df, row_number() OVER (ORDER BY n DESC, term) - 1 AS rank FROM stats WHERE df >= 5"
    out["cooccurrences"] = (
        f"{_WORDS}, spots AS (SELECT doc_id, unnest(string_split_regex(body, {_lit(_BLANKS)})) AS w, "
        f"unnest(range(1, len(string_split_regex(body, {_lit(_BLANKS)})) + 1)) AS i FROM trimmed WHERE NOT (body = '' AND cmt <> '')), "
        "near AS (SELECT w AS a, lead(w, 1) OVER o AS b1, lead(w, 2) OVER o AS b2 FROM spots WINDOW o AS (PARTITION BY doc_id ORDER BY i)), "
        "once AS (SELECT a, b1 AS b FROM near WHERE b1 IS NOT NULL UNION ALL SELECT a, b2 FROM near WHERE b2 IS NOT NULL), "
        "both_ways AS (SELECT a, b FROM once UNION ALL SELECT b, a FROM once) "
        "SELECT p.a, p.b, count(*) AS n, any_value(x.n) AS n_a, any_value(y.n) AS n_b FROM both_ways p "
        "JOIN stats x ON x.term = p.a AND x.n >= 20 JOIN stats y ON y.term = p.b AND y.n >= 20 GROUP BY p.a, p.b"
    )
    out["document_terms"] = f"{_WORDS} SELECT doc_id, term, tf FROM per_doc"
    out["term_tfidf"] = (
        f"{_WORDS} SELECT doc_id, term, tf, df, "
        "round(tf * ln(((SELECT CAST(count(*) AS DOUBLE) FROM documents) + 1) / (df + 1)), 6) AS tfidf "
        "FROM per_doc JOIN stats USING (term)"
    )
    for arch in formulas.HIDDEN:
        values = ", ".join(f"round({sql}, 10) AS p{i}" for i, sql in enumerate(formulas.outputs(arch)))
        out[f"forward_{arch}"] = f"SELECT l_orderkey, l_linenumber, {values} FROM lineitem"
    for arch in ("mlp", "rnn"):
        out[f"gradient_{arch}"] = formulas.gradient_sql(arch)
    for name in ("stored_model", "stream_score", "random_split", "exact_split", "auto_label_rest"):
        out[f"{name}_difference"] = "SELECT CAST(0 AS BIGINT) AS n_different"
    out["count_vectors"] = f"{_WORDS} SELECT doc_id, term, tf FROM per_doc JOIN stats USING (term) WHERE df >= 5"
    out["hashing_tf"] = f"{_WORDS} SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n_words FROM per_doc GROUP BY doc_id"
    buckets = f"{_WORDS}, placed AS (SELECT term, {formulas.bucket_sql('term', HASHED)} AS bucket FROM stats)"
    out["hashed_counts"] = (
        f"{buckets} SELECT doc_id, CAST(bucket AS INTEGER) AS bucket, CAST(sum(tf) AS DOUBLE) AS value FROM per_doc JOIN placed USING (term) GROUP BY doc_id, bucket"
    )
    out["split_features"] = (
        f"{buckets}, {_REVIEWS}, sides AS (SELECT doc_id, {_value('general')} AS general, "
        "CASE WHEN CAST('0x' || substr(md5('50:' || doc_id), 1, 8) AS BIGINT) % 1000 < 800 THEN 'train' ELSE 'test' END AS side FROM reviews), "
        "cells AS (SELECT side, doc_id, any_value(general) AS general, bucket, sum(tf) AS tf FROM per_doc JOIN placed USING (term) JOIN sides USING (doc_id) GROUP BY side, doc_id, bucket), "
        "known AS (SELECT bucket, count(*) AS df FROM cells WHERE side = 'train' GROUP BY bucket) "
        "SELECT side, doc_id, general, CAST(bucket AS INTEGER) AS bucket, round(value, 6) AS value FROM (SELECT *, tf * ln(((SELECT CAST(count(*) AS DOUBLE) FROM sides WHERE side = 'train') + 1) / "
        "(coalesce(df, 0) + 1)) AS value FROM cells LEFT JOIN known USING (bucket)) WHERE value <> 0"
    )
    known = ", ".join(_lit(f"{a} {b}") for a, b in formulas.PHRASES)
    out["clean_advanced_phrases"] = (
        f"WITH {_TEXTS}, docs AS (SELECT doc_id, list_filter(string_split_regex(coalesce({_advanced('cmt')}, ''), {_lit(_BLANKS + '+')}), lambda w: w <> '') AS words FROM texts), "
        f"flags AS (SELECT *, array_to_string(list_transform(range(1, len(words)), lambda i: CASE WHEN list_contains([{known}], words[i] || ' ' || words[i + 1]) THEN '1' ELSE '0' END), '') AS f FROM docs), "
        "joined AS (SELECT doc_id, words, regexp_replace(f, '11', '10', 'g') AS hits FROM flags) "
        "SELECT doc_id, array_to_string(list_transform(words, lambda w, i: w || CASE WHEN i = len(words) THEN '' "
        "WHEN substr(hits, i, 1) = '1' THEN '_' ELSE ' ' END), '') AS cmt FROM joined"
    )
    out["score_fixed"] = f"WITH {_TEXTS}, {_fixed('mlp', _advanced)} SELECT doc_id, {_aspect_columns(lambda j, a: _sentence(f'p{j}'))} FROM guesses"
    out["score_stream_fixed"] = out["score_fixed"]
    inline = " UNION ALL ".join(f"SELECT CAST(NULL AS BIGINT), {_lit(t)}" for t in formulas.SENTENCES)
    out["score_sentences"] = (
        f"WITH {_TEXTS}, both_kinds AS (SELECT doc_id, cmt FROM texts UNION ALL {inline}), {_fixed('rnn', _basic, 'both_kinds')} "
        f"SELECT doc_id, {_aspect_columns(lambda j, a: _sentence(f'p{j}'))} FROM guesses"
    )
    dealt = sorted(f"{arch}-{mode}" for arch in formulas.HIDDEN for mode in ("basic", "advanced"))
    out["score_slots_fixed"] = " UNION ALL ".join(
        f"SELECT * FROM (WITH {_TEXTS}, mine AS (SELECT doc_id, cmt FROM texts WHERE doc_id % {len(dealt)} = {dealt.index(f'{arch}-{mode}')}), "
        f"{_fixed(arch, clean, 'mine')} SELECT doc_id, '{arch}-{mode}' AS slot, {_aspect_columns(lambda j, a: _sentence(f'p{j}'))} FROM guesses)"
        for arch in formulas.HIDDEN for mode, clean in (("basic", _basic), ("advanced", _advanced))
    )
    out["evaluate_fixed"] = _evaluated("gru", _basic)
    out["compare_models_fixed"] = " UNION ALL ".join(
        f"SELECT '{arch}-{mode}' AS slot, * FROM ({_evaluated(arch, clean)})"
        for arch in formulas.HIDDEN for mode, clean in (("basic", _basic), ("advanced", _advanced))
    )
    coded = f"{_READERS}, {_fixed('mlp', _annotation, 'reviews')}, coded AS (SELECT doc_id AS id, " + ", ".join(
        f"CASE WHEN p{j} <= -1.5 THEN 0 WHEN p{j} < -0.5 THEN 1 WHEN p{j} <= 0.5 THEN 2 ELSE 3 END AS n{j}" for j in _K
    ) + " FROM guesses)"
    fresh = [f"CASE n{j} WHEN 1 THEN 'negative' WHEN 2 THEN 'neutral' WHEN 3 THEN 'positive' END" for j in _K]
    out["classify_fixed"] = f"{coded} SELECT id, " + ", ".join(f"n{j} AS {_q(a)}" for j, a in enumerate(ANNOTATION_ASPECTS)) + " FROM coded"
    out["auto_label_all_fixed"] = f"{coded} SELECT id, " + ", ".join(f"{n} AS {_q(a)}" for n, a in zip(fresh, ANNOTATION_ASPECTS, strict=True)) + " FROM coded"
    out["auto_label_some_fixed"] = (
        f"{coded}, chosen AS (SELECT DISTINCT doc_id AS id FROM labels WHERE quality = 0) SELECT id, " + ", ".join(
            f"CASE WHEN id IN (SELECT id FROM chosen) THEN {n} ELSE {old} END AS {_q(a)}"
            for n, old, a in zip(fresh, _NAMES, ANNOTATION_ASPECTS, strict=True)
        ) + " FROM a1 JOIN coded ON coded.id = a1.doc_id"
    )
    out["gram_lexicon"] = f"{_grams(_basic)} SELECT word, n, cost FROM lexicon"
    out["segment_words"] = out["segment_words_joined"] = _segments(_basic)
    out["clean_advanced_words"] = _segments(_advanced)
    out["learn_phrases"] = f"{_PHRASES} SELECT a, b, n_ab, n_a, n_b, round(score, 6) AS score FROM found"
    out["apply_phrases"] = (
        f"{_PHRASES}, flags AS (SELECT doc_id, string_agg(CASE WHEN f.a IS NULL THEN '0' ELSE '1' END, '' ORDER BY i) AS hits "
        "FROM spots LEFT JOIN found f ON f.a = words[i] AND f.b = words[i + 1] WHERE i < len(words) GROUP BY doc_id), "
        "joined AS (SELECT doc_id, words, regexp_replace(coalesce(hits, ''), '11', '10', 'g') AS hits FROM docs LEFT JOIN flags USING (doc_id)) "
        "SELECT doc_id, array_to_string(list_transform(words, lambda w, i: w || CASE WHEN i = len(words) THEN '' "
        "WHEN substr(hits, i, 1) = '1' THEN '_' ELSE ' ' END), '') AS cmt FROM joined"
    )
    return out
