"""The same results as plain SQL over the driver tables, for the checks.

Common table expressions are named pieces; ``sql`` puts together the ones a
query needs.  This is an independent formulation: prefix tests, nested joins and
unnested text where the Spark side uses ancestor joins and features.
"""

from __future__ import annotations

import re

from knotmeter import rules
from knotmeter.functions.matching import literal_of
from knotmeter.functions.paths import globs_regex
from knotmeter.operators import significance
from knotmeter.plans import corpus, queries

ORACLES: dict[str, str] = {}


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def qlist(values) -> str:
    return ", ".join(q(v) for v in values)


def any_of(conditions) -> str:
    return "(" + " OR ".join(conditions) + ")"


def total(terms) -> str:
    return "(" + " + ".join(terms) + ")"


def count_sql(text: str, pattern: str) -> str:
    literal = literal_of(pattern)
    if literal is None:
        return f"len(regexp_extract_all({text}, {q(pattern)}))"
    return f"CAST((length({text}) - length(replace({text}, {q(literal)}, ''))) / {len(literal)} AS BIGINT)"


def has_sql(text: str, pattern: str) -> str:
    literal = literal_of(pattern)
    if literal is None:
        return f"regexp_matches({text}, {q(pattern)})"
    return f"contains({text}, {q(literal)})"


def contains_any(text: str, words) -> str:
    return any_of(f"contains({text}, {q(w)})" for w in words)


def ends(extensions, column="name") -> str:
    return any_of(f"ends_with({column}, {q(e)})" for e in extensions)


def code_sql(column: str, words=corpus.CODE_WORDS) -> str:
    for word, code in words:
        column = f"replace({column}, {q(word)}, {q(code)})"
    return column


def values(rows) -> str:
    def cell(x):
        return q(x) if isinstance(x, str) else str(x)

    return "(VALUES " + ", ".join("(" + ", ".join(cell(x) for x in r) + ")" for r in rows) + ")"


def service_cte(indicators, chain, extension_chain=()) -> str:
    whens = " ".join(f"WHEN bool_or(name IN ({qlist(m)})) THEN {q(lang)}" for m, lang in chain)
    whens += " ".join(f" WHEN bool_or(ends_with(name, {q(e)})) THEN {q(lang)}" for e, lang in extension_chain)
    return f"""
      SELECT c.* FROM (
        SELECT project_id, CASE WHEN dir = '.' THEN project_id ELSE string_split(dir, '/')[-1] END AS name,
               dir AS path, CASE {whens} ELSE 'Unknown' END AS language,
               string_agg(name, '|' ORDER BY list_position([{qlist(indicators)}], name))
                 FILTER (WHERE name IN ({qlist(indicators)})) AS indicators,
               count(*) FILTER (WHERE NOT name_ignored) AS file_count,
               bool_or(name = 'Dockerfile') AS has_docker,
               bool_or(name IN ('requirements.txt', 'package.json')) AS has_requirements
        FROM tree GROUP BY project_id, dir HAVING bool_or(name IN ({qlist(indicators)}))) c
      WHERE NOT EXISTS (SELECT 1 FROM tree t WHERE t.project_id = c.project_id
        AND t.name IN ({qlist(indicators)}) AND t.dir <> '.' AND starts_with(c.path, t.dir || '/'))"""


def pipeline_cte(globs, code, keep_empty, n) -> str:
    rx = q("^" + globs_regex(globs) + "$")
    join = "LEFT JOIN" if keep_empty else "JOIN"
    return f"""
      SELECT d.project_id, d.name, d.path, CAST(count(t.path) AS BIGINT) AS stages,
             coalesce(array_to_string(list_sort(list(t.path) FILTER (WHERE t.path IS NOT NULL))[1:{n}], '|'), '') AS files
      FROM (SELECT DISTINCT a.project_id, a.owner AS path,
                   CASE WHEN a.owner = '.' THEN a.project_id ELSE string_split(a.owner, '/')[-1] END AS name
            FROM owners a) d
      {join} tree t ON t.project_id = d.project_id AND (d.path = '.' OR starts_with(t.path, d.path || '/'))
        AND {ends(code, 't.name')}
      WHERE regexp_matches(lower(d.name), {rx}) OR EXISTS (SELECT 1 FROM tree f
            WHERE f.project_id = d.project_id AND f.dir = d.path AND regexp_matches(lower(f.name), {rx}))
      GROUP BY d.project_id, d.name, d.path"""


def language_rank(catalogue, by_name=True) -> str:
    rows = []
    for i, (lang, entries) in enumerate(catalogue.items()):
        rows += [(i, lang, e) for e in entries]
    keys = "(r.entry = t.extension OR r.entry = t.name)" if by_name else "r.entry = t.extension"
    return f"""
      SELECT t.project_id, t.path, arg_min(r.lang, r.ord) AS language
      FROM tree t JOIN {values(rows)} r(ord, lang, entry) ON {keys}
      WHERE t.extension <> '' AND KEEP GROUP BY t.project_id, t.path"""


def glue_lines(mode) -> str:
    parts = []
    for patterns in rules.GLUE_PATTERNS.values():
        if mode == "reference":
            patterns = [re.escape(p) for p in patterns]
        parts.append("len(regexp_extract_all(content, " + q("(?im)^.*(?:" + "|".join(patterns) + ").*$") + "))")
    return total(parts)


def feature_cte(mode="intended") -> str:
    def n(*words):
        return total(count_sql("content", re.escape(w)) for w in words)

    py = "ends_with(name, '.py')"
    train = "NOT ignored AND contains(lower(name), 'train')"
    return f"""
      SELECT project_id, path, dir, name, extension, size, ignored, {py} AS is_python,
        CASE WHEN {ends(rules.MODEL_CALL_CODE)} THEN {total(count_sql('content', p) for p in rules.LOADING_PATTERNS)} ELSE 0 END AS loading_hits,
        CASE WHEN {ends(rules.MODEL_CALL_CODE)} AND {contains_any('content', rules.PREDICTION_GATE)}
             THEN {total(count_sql('content', p) for p in rules.PREDICTION_PATTERNS)} ELSE 0 END AS prediction_hits,
        CASE WHEN {ends(rules.GLUE_CODE)} THEN len(string_split(content, chr(10))) - CASE WHEN content = '' OR ends_with(content, chr(10)) THEN 1 ELSE 0 END ELSE 0 END AS code_lines,
        CASE WHEN {ends(rules.GLUE_CODE)} THEN {glue_lines(mode)} ELSE 0 END AS glue_lines,
        CASE WHEN {py} THEN {n('if ', 'elif ', 'case ')} ELSE 0 END AS branches,
        CASE WHEN {py} THEN {n('if ', 'elif ', 'else:', 'for ', 'while ')} ELSE 0 END AS flow_words,
        CASE WHEN {py} THEN {n('def ')} ELSE 0 END AS defs,
        {py} AND {contains_any('content', ['branch', 'case'])} AS mentions_branching,
        {py} AND {any_of(has_sql('content', p) for p in rules.PREDICTION_PATTERNS)} AS has_prediction,
        {py} AND {contains_any('lower(content)', rules.STORAGE_WORDS)} AS has_storage,
        {py} AND (contains(name, 'train') OR contains(content, 'fit')) AS is_training,
        {py} AND {contains_any('lower(content)', rules.DB_READ_WORDS)} AS has_db_read,
        CASE WHEN {py} THEN regexp_extract_all(content, {q(r'(?m)^(?:from|import)\s+([\p{L}\p{N}_.]+)')}, 1) END AS imports,
        {train} AND {contains_any('lower(content)', rules.SCHEDULE_WORDS)} AS has_schedule,
        {train} AND {contains_any('lower(content)', rules.TRIGGER_WORDS)} AS has_trigger,
        contains(lower(name), 'bug') OR contains(lower(name), 'fix') AS bug_name,
        CASE WHEN {ends(rules.CONSUMER_CODE)} THEN {n('TODO', 'FIXME')} ELSE 0 END AS todos,
        {ends(rules.CONSUMER_CODE)} AND {contains_any('content', ['TODO', 'FIXME', 'BUG'])} AS bug_marker
      FROM tree"""


def first_reference(text: str, quoted: str, pretrained=False) -> str:
    options = [quoted, r"([\p{L}\p{N}_]*model[\p{L}\p{N}_]*)\s*="]
    if pretrained:
        options.append(rules.PRETRAINED_PATTERN)
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({text}, {q(o)}, 1), '')" for o in options) + ")"


def code_ref_cte() -> str:
    parts = []
    for o, pattern in enumerate(rules.MODEL_REFERENCE_PATTERNS):
        lit = q(literal_of(pattern))
        parts.append(
            f"SELECT project_id, path, {o} AS o, i, right(array_to_string(p[1:i], {lit}), 50) || {lit} || "
            f"left(array_to_string(p[i+1:], {lit}), 50) AS context FROM (SELECT project_id, path, p, "
            f"unnest(range(1, len(p))) AS i FROM (SELECT project_id, path, string_split(content, {lit}) AS p "
            f"FROM tree WHERE NOT ignored AND extension IN ('.py', '.js', '.java', '.r', '.ipynb')))"
        )
    return f"""
      SELECT project_id, path, name, context FROM (
        SELECT *, row_number() OVER (PARTITION BY project_id, path, name ORDER BY o, i) AS rn FROM (
          SELECT *, {first_reference('context', rules.QUOTED_MODEL_PATTERN)} AS name FROM ({' UNION ALL '.join(parts)}))
        WHERE name IS NOT NULL) WHERE rn = 1"""


def references_cte() -> str:
    langs = {"python": ".py", "r": ".r", "javascript": ".js", "java": ".java"}
    table = []
    for lang, frameworks in rules.DETECTOR_LOADING.items():
        for fw, patterns in frameworks.items():
            table += [(lang, "loading", fw, p) for p in patterns]
    for kind, by_lang in (("prediction", rules.DETECTOR_PREDICTION), ("training", rules.DETECTOR_TRAINING)):
        for lang, patterns in by_lang.items():
            table += [(lang, kind, "", p) for p in patterns]
    parts = []
    for lang, kind, fw, p in table:
        parts.append(
            f"SELECT project_id, path, {q(lang)} AS language, line, {q(kind)} AS kind, {q(fw)} AS framework, "
            f"{q(p)} AS pattern, trim(code, ' ') AS context, code, unnest(range({count_sql('code', p)})) AS o FROM src_lines "
            f"WHERE {'(ends_with(name, ' + q('.r') + ') OR ends_with(name, ' + q('.R') + '))' if lang == 'r' else 'ends_with(name, ' + q(langs[lang]) + ')'} AND {has_sql('code', p)}"
        )
    ref = first_reference("code", rules.DETECTOR_QUOTED_MODEL_PATTERN, True)
    return (
        f"SELECT project_id, path, language, line, kind, framework, pattern, context, "
        f"CASE WHEN kind = 'loading' THEN {ref} END AS model_reference FROM ({' UNION ALL '.join(parts)})"
    )


def endpoint_cte() -> str:
    parts = []
    for lang, frameworks in rules.ENDPOINT_PATTERNS.items():
        for fw, patterns in frameworks.items():
            for p in patterns:
                groups = p.count("(") - p.count(r"\(")
                if not groups:
                    continue
                method = f"upper(regexp_extract(m, {q(p)}, 1))" if groups == 2 else "'GET'"
                parts.append(
                    f"SELECT project_id, path, {q(lang)} AS lang, {q(fw)} AS framework, {method} AS method, "
                    f"regexp_extract(m, {q(p)}, {groups}) AS endpoint FROM (SELECT project_id, path, "
                    f"unnest(regexp_extract_all(content, {q(p)})) AS m FROM tree WHERE {ends(rules.ENDPOINT_CODE)})"
                )
    return f"""
      SELECT s.project_id, s.name AS service, s.path AS service_path,
             CASE WHEN s.path = '.' THEN h.path ELSE substr(h.path, length(s.path) + 2) END AS file,
             h.framework, h.method, h.endpoint AS path
      FROM ({' UNION ALL '.join(parts)}) h JOIN svc s ON s.project_id = h.project_id
        AND (s.path = '.' OR starts_with(h.path, s.path || '/')) AND contains(s.language, h.lang)"""


def evidence_cte() -> str:
    parts = []
    for fw, (cat, patterns, fragments, _) in rules.FRAMEWORKS.items():
        for f in fragments:
            parts.append(
                f"SELECT project_id, path, {q(fw)} AS framework, {q(cat)} AS category, 'file' AS kind, "
                f"{q(f)} AS value, CAST(1 AS BIGINT) AS weight FROM tree WHERE contains(path, {q(f)})"
            )
        if patterns:
            case = " ".join(f"WHEN regexp_matches(content, {q('(?i)' + p)}) THEN {q(p)}" for p in patterns)
            parts.append(
                f"SELECT * FROM (SELECT project_id, path, {q(fw)}, {q(cat)}, 'code', CASE {case} END AS value, "
                f"CAST(2 AS BIGINT) FROM tree WHERE {ends(rules.FRAMEWORK_CODE)}) WHERE value IS NOT NULL"
            )
    return " UNION ALL ".join(parts)


def dependency_cte() -> str:
    rows = [(fw, d) for fw, (_, _, _, deps) in rules.FRAMEWORKS.items() for d in deps]
    v = f"{values(rows)} r(framework, rule)"
    return f"""
      SELECT project_id, framework, 'package.json' AS file, package AS dependency FROM packages JOIN {v} ON package = rule WHERE dir = '.'
      UNION ALL SELECT project_id, framework, 'requirements.txt', package FROM reqs JOIN {v} ON contains(package, rule) WHERE dir = '.'
      UNION ALL SELECT project_id, framework, 'pom.xml', rule FROM tree JOIN {v} ON contains(content, rule) WHERE path = 'pom.xml'"""


IGNORE = globs_regex(rules.IGNORE_GLOBS)
CTES: dict[str, str] = {
    "docs": f"""SELECT doc_id, source, n_chars, k, CAST(floor(k / 10) AS BIGINT) AS g, k % 10 AS j, code
      FROM (SELECT doc_id, source, n_chars, CAST(floor(doc_id / 20) AS BIGINT) AS k, {code_sql('text')} AS code FROM documents)""",
    "files": f"""SELECT source AS project_id, {corpus.PATH} AS path, n_chars AS size,
      TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id AS INTEGER)) AS modified,
      CASE WHEN j = 0 AND g % 2 = 1 AND k <> 9 THEN
        '{{"dependencies":{{"express":"^' || k || '","react":"^' || n_chars || '"}},"devDependencies":{{"jest":"' || doc_id
        || '","express":"dev' || doc_id || '"}},"readme":' || CAST(to_json(code) AS VARCHAR) || '}}' ELSE code END AS content
      FROM docs""",
    "tree": f"""SELECT *, lower(regexp_extract(name, {q(r'(?s)^\.*[^.].*(\.[^.]*)$')}, 1)) AS extension,
      regexp_matches(path, {q('(?:^|/)' + IGNORE + '(?:/|$)')}) AS ignored,
      regexp_matches(name, {q('^' + IGNORE + '$')}) AS name_ignored
      FROM (SELECT *, string_split(path, '/')[-1] AS name,
        CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS dir FROM files)""",
    "dirs": "SELECT DISTINCT project_id, dir FROM tree",
    "owners": """SELECT project_id, dir, '.' AS owner FROM dirs UNION
      SELECT project_id, dir, array_to_string(string_split(dir, '/')[1:i], '/') FROM (
        SELECT *, unnest(range(1, len(string_split(dir, '/')) + 1)) AS i FROM dirs WHERE dir <> '.')""",
    "lang1": language_rank(rules.LANGUAGE_FILES).replace("KEEP", "NOT t.ignored"),
    "lang2": language_rank(rules.SCANNER_LANGUAGE_FILES).replace("KEEP", "NOT t.ignored"),
    "lang3": language_rank({k: v for k, (v, _) in rules.DETECTOR_LANGUAGES.items()}, False).replace("KEEP", "true")
    + f""" UNION ALL SELECT DISTINCT t.project_id, t.path, r.lang FROM tree t
      JOIN {values([(k, i) for k, (_, v) in rules.DETECTOR_LANGUAGES.items() for i in v])} r(lang, ind) ON contains(t.name, r.ind)""",
    "lang_order": f"SELECT * FROM {values([(k, i) for i, k in enumerate(rules.DETECTOR_LANGUAGES)])} v(language, ord)",
    "lang1_order": f"SELECT * FROM {values([(k, i) for i, k in enumerate(rules.LANGUAGE_FILES)])} v(language, ord)",
    "svc": service_cte(rules.SERVICE_INDICATORS, rules.SERVICE_LANGUAGE_CHAIN),
    "svc2": service_cte(
        rules.SCANNER_SERVICE_INDICATORS, rules.SCANNER_SERVICE_LANGUAGE_CHAIN,
        rules.SCANNER_SERVICE_EXTENSION_CHAIN,
    ),
    "svc_files": """SELECT s.project_id, s.name AS service, s.path AS owner_path, t.path, t.size
      FROM svc s JOIN tree t ON t.project_id = s.project_id AND (s.path = '.' OR starts_with(t.path, s.path || '/'))""",
    "pipes": pipeline_cte(rules.PIPELINE_GLOBS, rules.PIPELINE_CODE, False, 10),
    "pipes2": pipeline_cte(rules.SCANNER_PIPELINE_GLOBS, rules.SCANNER_PIPELINE_CODE, True, 20),
    "feat": feature_cte(),
    "feat_lit": feature_cte("reference"),
    "model_files": f"""SELECT project_id, name, path, coalesce(v.type, 'Unknown') AS type, size, modified
      FROM tree LEFT JOIN {values(list(rules.MODEL_TYPES.items()))} v(ext, type) ON v.ext = extension
      WHERE NOT ignored AND extension IN ({qlist(rules.MODEL_EXTENSIONS)})""",
    "model_files2": f"""SELECT project_id, name, path, coalesce(v.type, 'Unknown') AS type, size, modified
      FROM tree LEFT JOIN {values(list(rules.SCANNER_MODEL_TYPES.items()))} v(ext, type) ON v.ext = extension
      WHERE NOT ignored AND extension IN ({qlist(rules.SCANNER_MODEL_EXTENSIONS)})""",
    "facts": f"""SELECT t.project_id, t.name, t.path, t.extension, arg_min(v.fw, v.ord) AS framework, t.size,
      round_even(t.size / 1024, 2) AS size_kb, round_even(t.size / 1048576, 2) AS size_mb,
      regexp_extract(t.name, {q(rules.MODEL_VERSION_PATTERN)}, 0) AS version,
      CASE {' '.join(f"WHEN contains(lower(t.name), {q(a)}) THEN {q(a)}" for a in rules.MODEL_ARCHITECTURES)} ELSE '' END AS architecture
      FROM tree t JOIN {values([(i, fw, e) for i, (fw, es) in enumerate(rules.DETECTOR_MODEL_EXTENSIONS.items()) for e in es])} v(ord, fw, ext)
        ON v.ext = t.extension GROUP BY t.project_id, t.name, t.path, t.extension, t.size""",
    "code_refs": code_ref_cte(),
    "models": "SELECT project_id, name, path FROM model_files UNION ALL SELECT project_id, name, path FROM code_refs",
    "model_names": "SELECT DISTINCT project_id, name AS model FROM models",
    "src_lines": """SELECT project_id, path, name, unnest(lines) AS code, unnest(range(1, len(lines) + 1)) AS line
      FROM (SELECT project_id, path, name, string_split(content, chr(10)) AS lines FROM tree)""",
    "refs": references_cte(),
    "metadata": f"""SELECT project_id, name, path, CASE WHEN contains(name, 'config') THEN 'config'
      WHEN contains(name, 'checkpoint') THEN 'checkpoint' ELSE 'other' END AS type, size FROM tree
      WHERE regexp_matches(name, {q('^(?:' + '|'.join(g.replace('*', '.*') for g in rules.MODEL_METADATA_GLOBS) + ')')})""",
    "missing": """SELECT r.* FROM refs r WHERE r.kind = 'loading' AND r.model_reference IS NOT NULL AND NOT EXISTS (
      SELECT 1 FROM facts f WHERE f.project_id = r.project_id AND f.name = r.model_reference)""",
    "eps": endpoint_cte(),
    "deps": f"""SELECT DISTINCT a.project_id, a.name AS source, b.name AS target
      FROM svc a JOIN tree t ON t.project_id = a.project_id AND (a.path = '.' OR starts_with(t.path, a.path || '/')) AND {ends(rules.ENDPOINT_CODE, 't.name')}
      JOIN svc b ON b.project_id = a.project_id AND b.name <> a.name
      WHERE contains(t.content, 'http://' || b.name) OR contains(t.content, 'https://' || b.name)
        OR contains(t.content, b.name || '.com') OR (b.path <> '.' AND contains(t.content, b.path))
        OR contains(t.content, '/' || b.name || '/')""",
    "reqs": """SELECT project_id, dir, path, requirement, regexp_extract(requirement, '^(.*?)(==|>=|<=|$)', 1) AS package FROM (
      SELECT project_id, dir, path, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS requirement FROM (
        SELECT project_id, dir, path, unnest(string_split(content, chr(10))) AS line FROM tree WHERE name = 'requirements.txt'))
      WHERE requirement <> '' AND NOT starts_with(requirement, '#')""",
    "packages": """SELECT project_id, dir, path, package, coalesce(json_extract_string(content, '$.devDependencies.' || package),
        json_extract_string(content, '$.dependencies.' || package)) AS version FROM (
      SELECT DISTINCT project_id, dir, path, content, unnest(list_concat(json_keys(content, '$.dependencies'),
        json_keys(content, '$.devDependencies'))) AS package FROM tree WHERE name = 'package.json')""",
    "evid": evidence_cte(),
    "fw_files": """SELECT project_id, framework, category, least(10, CAST(sum(weight) AS BIGINT)) AS confidence,
      count(*) AS file_evidence FROM evid GROUP BY ALL""",
    "fw_deps": dependency_cte(),
    "fw_all": f"""SELECT project_id, framework, v.category, file_evidence, dependency_evidence,
      least(10, file_evidence * 2 + dependency_evidence * 3) AS confidence FROM (
        SELECT project_id, framework, CAST(sum(f) AS BIGINT) AS file_evidence, CAST(sum(d) AS BIGINT) AS dependency_evidence FROM (
          SELECT project_id, framework, 1 AS f, 0 AS d FROM evid UNION ALL SELECT project_id, framework, 0, 1 FROM fw_deps)
        GROUP BY ALL) JOIN {values([(k, v[0]) for k, v in rules.FRAMEWORKS.items()])} v(fw, category) ON v.fw = framework""",
    "calls": """SELECT s.project_id, s.name AS service, s.path, CAST(sum(f.loading_hits) AS BIGINT) AS loading_hits,
      CAST(sum(f.prediction_hits) AS BIGINT) AS prediction_hits, CAST(sum(f.loading_hits + f.prediction_hits) AS BIGINT) AS hits
      FROM svc s JOIN feat f ON f.project_id = s.project_id AND (s.path = '.' OR starts_with(f.path, s.path || '/'))
      GROUP BY ALL HAVING sum(f.loading_hits + f.prediction_hits) > 0""",
    "glue": """SELECT s.project_id, s.name AS service, s.path, CAST(sum(f.glue_lines) AS BIGINT) AS glue_lines,
      CAST(sum(f.code_lines) AS BIGINT) AS total_lines FROM svc s JOIN feat f ON f.project_id = s.project_id
      AND (s.path = '.' OR starts_with(f.path, s.path || '/')) GROUP BY ALL HAVING sum(f.code_lines) > 0""",
    "glue_lit": """SELECT s.project_id, s.name AS service, s.path, CAST(sum(f.glue_lines) AS BIGINT) AS glue_lines,
      CAST(sum(f.code_lines) AS BIGINT) AS total_lines FROM svc s JOIN feat_lit f ON f.project_id = s.project_id
      AND (s.path = '.' OR starts_with(f.path, s.path || '/')) GROUP BY ALL HAVING sum(f.code_lines) > 0""",
    "mentions": f"""SELECT t.project_id, t.dir, t.path, t.extension, t.ignored, m.model, t.content
      FROM tree t JOIN model_names m ON m.project_id = t.project_id AND contains(t.content, m.model)
      WHERE {ends(rules.CONSUMER_CODE, 't.name')}""",
    "located": """SELECT * EXCLUDE (tail, head), len(string_split(head, chr(10))) AS last_line,
      trim(string_split(head, chr(10))[-1] || model || string_split(tail, chr(10))[1], ' ') AS last_code FROM (
        SELECT *, left(content, length(content) - length(tail) - length(model)) AS head FROM (
          SELECT *, string_split(content, model)[-1] AS tail FROM mentions))""",
    "declared": """SELECT DISTINCT s.project_id, m.model, s.name AS consumer FROM svc s
      JOIN tree t ON t.project_id = s.project_id AND (t.path = CASE WHEN s.path = '.' THEN '' ELSE s.path || '/' END || 'README.md'
        OR t.path = CASE WHEN s.path = '.' THEN '' ELSE s.path || '/' END || 'README.txt'
        OR t.path = CASE WHEN s.path = '.' THEN '' ELSE s.path || '/' END || 'docs/README.md')
      JOIN model_names m ON m.project_id = s.project_id AND replace(replace(m.model, '.pkl', ''), '.h5', '') <> ''
        AND contains(lower(t.content), lower(replace(replace(m.model, '.pkl', ''), '.h5', '')))""",
    "actual": """SELECT project_id, model, consumer, CASE WHEN owner = '.' THEN path ELSE substr(path, length(owner) + 2) END AS file,
      last_line AS line, last_code AS code FROM (
        SELECT l.*, s.name AS consumer, s.path AS owner, row_number() OVER (PARTITION BY l.project_id, l.model, s.name
          ORDER BY l.path DESC, l.last_line DESC, s.path DESC) AS rn
        FROM located l JOIN svc s ON s.project_id = l.project_id AND (s.path = '.' OR starts_with(l.path, s.path || '/')))
      WHERE rn = 1""",
    "hidden": """SELECT project_id, model, consumer, 'undocumented' AS type, file, line FROM actual a WHERE NOT EXISTS (
      SELECT 1 FROM declared d WHERE d.project_id = a.project_id AND d.model = a.model AND d.consumer = a.consumer)""",
    "impact": """SELECT n.project_id, n.model, count(DISTINCT s.name) AS impact_radius FROM model_names n
      LEFT JOIN mentions m ON m.project_id = n.project_id AND m.model = n.model
      LEFT JOIN svc s ON s.project_id = m.project_id AND (s.path = '.' OR starts_with(m.path, s.path || '/')) GROUP BY ALL""",
    "retrain": """SELECT project_id, path AS file, has_schedule, has_trigger, CASE WHEN has_schedule THEN 'scheduled'
      ELSE 'triggered' END AS reason FROM feat WHERE has_schedule OR has_trigger""",
    "loops": """SELECT s.project_id, s.name AS service, s.path AS service_path,
      CASE WHEN s.path = '.' THEN f.path ELSE substr(f.path, length(s.path) + 2) END AS file,
      CASE WHEN f.has_prediction THEN 'prediction_to_storage' ELSE 'training_from_prod' END AS type
      FROM svc s JOIN feat f ON f.project_id = s.project_id AND (s.path = '.' OR starts_with(f.path, s.path || '/'))
      WHERE f.is_python AND ((f.has_prediction AND f.has_storage) OR (f.is_training AND f.has_db_read))""",
    "imps": """SELECT DISTINCT f.project_id, f.module, s.name AS service FROM (
        SELECT project_id, path, unnest(imports) AS module FROM feat WHERE is_python) f
      JOIN svc s ON f.project_id = s.project_id AND (s.path = '.' OR starts_with(f.path, s.path || '/'))""",
    "shared": "SELECT project_id, module, count(*) AS services FROM imps GROUP BY ALL HAVING count(*) > 1",
    "cplx": """SELECT *, stages > 5 OR branching_factor > 2 AS is_complex FROM (
      SELECT p.project_id, p.name, p.path, p.stages,
        round_even(coalesce(sum(f.branches), 0) / greatest(count(f.path), 1) + 1, 2) AS branching_factor
      FROM pipes p LEFT JOIN feat f ON f.project_id = p.project_id AND f.is_python
        AND (p.path = '.' OR starts_with(f.path, p.path || '/')) GROUP BY p.project_id, p.name, p.path, p.stages)""",
    "compose": """SELECT 'src' || (s_suppkey % 20) AS project_id, 'svc' || CAST(floor(s_suppkey / 20) AS BIGINT) AS name,
      'registry/svc' || CAST(floor(s_suppkey / 20) AS BIGINT) || ':' || s_nationkey AS image,
      CASE WHEN s_suppkey % 3 = 0 THEN './Models:/m' ELSE '' END AS mounts FROM supplier""",
    "commits": """SELECT 'src' || (o_orderkey % 20) AS project_id, CAST(o_orderkey AS VARCHAR) AS commit_id,
      'dev' || o_custkey AS author, o_orderdate AS committed_at,
      replace(replace(replace(o_orderpriority, '1-URGENT', 'Hotfix crash'), '2-HIGH', 'Add feature'),
        '4-NOT SPECIFIED', 'resolve | issue') || ' #' || o_orderkey AS message FROM orders""",
    "clines": """SELECT 'src' || (l_orderkey % 20) AS project_id, CAST(l_orderkey AS VARCHAR) AS commit_id,
      CASE WHEN p_partkey % 7 = 0 THEN 'svc' || (p_partkey % 5) || '/models/model_' || (p_partkey % 5) || '.pkl'
        ELSE 'svc' || (p_partkey % 5) || '/' || lower(p_type) || '/part_' || p_partkey || '.py' END AS path,
      CAST(l_quantity AS BIGINT) AS added, CAST(l_linenumber AS BIGINT) AS deleted
      FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "cfiles": """SELECT project_id, commit_id, path, CAST(sum(added) AS BIGINT) AS added, CAST(sum(deleted) AS BIGINT) AS deleted
      FROM clines GROUP BY ALL""",
    "bugs": f"SELECT * FROM commits WHERE {contains_any('lower(message)', rules.BUG_KEYWORDS)}",
    "changes": """SELECT f.project_id, f.path, count(*) AS changes FROM cfiles f JOIN commits c USING (project_id, commit_id)
      WHERE c.committed_at >= TIMESTAMP '2001-02-01' GROUP BY ALL""",
    "ranked": """SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY changes DESC, path) AS rank FROM changes""",
    "ecommits": """SELECT 'src' || (user_id % 20) AS project_id, event_id, 'dev' || user_id AS author, ts AS committed_at,
      event_type AS message FROM events""",
    "repos": f"""SELECT s_suppkey AS id, 'org' || s_nationkey || '/' || lower(s_name) AS full_name,
      'tools of ' || lower(n_name) AS description, CAST(floor(s_acctbal) AS BIGINT) AS stars, s_suppkey * 7 % 101 AS forks,
      [topic[s_nationkey % 13 + 1], topic[(s_nationkey + 1 + s_suppkey % 3) % 13 + 1]] AS topics
      FROM supplier JOIN nation ON s_nationkey = n_nationkey, (SELECT [{qlist(corpus.TOPICS)}] AS topic)""",
    "m": """SELECT 'p' || o_custkey AS project_id, count(*) AS services_count,
      count(*) FILTER (o_orderpriority = '1-URGENT') AS direct_count,
      count(*) FILTER (o_orderpriority = '1-URGENT') / count(*) AS direct_ratio,
      count(*) FILTER (o_orderpriority = '2-HIGH') AS shared_count,
      count(*) FILTER (o_orderstatus = 'F') AS pipelines_count,
      count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority <> '5-LOW' AND month(o_orderdate) > 4) AS complex_pipelines,
      count(*) FILTER (month(o_orderdate) <= 4) AS retrain_count,
      count(*) FILTER (o_orderstatus = 'O') AS models_count,
      sum(month(o_orderdate)) / count(*) AS avg_impact,
      count(*) FILTER (o_orderpriority = '3-MEDIUM') AS loops_count,
      count(*) FILTER (o_orderpriority = '4-NOT SPECIFIED' AND month(o_orderdate) > 3) / count(*) AS glue_ratio,
      count(*) FILTER (o_orderpriority = '5-LOW') AS hidden_count,
      count(*) * 70 AS commit_count,
      count(*) FILTER (o_orderstatus = 'P' AND year(o_orderdate) > 1997) / count(*) AS bug_rate,
      sum(month(o_orderdate)) / count(*) + count(*) FILTER (year(o_orderdate) = 1999) AS avg_change_impact,
      count(*) FILTER (year(o_orderdate) <= 1997) AS top5_changes, count(*) AS top20_changes,
      CAST(max(CASE WHEN o_orderpriority = '2-HIGH' THEN month(o_orderdate) END) AS DOUBLE) AS isolated_mean,
      CAST(max(CASE WHEN o_orderpriority = '5-LOW' THEN month(o_orderdate) + 4 END) AS DOUBLE) AS non_isolated_mean
      FROM orders GROUP BY o_custkey""",
    "mc": """SELECT *, least(1.0::DOUBLE, direct_ratio / 0.3::DOUBLE) AS direct_calls,
      CASE WHEN services_count > 0 THEN least(1.0::DOUBLE, shared_count / (services_count * 0.5::DOUBLE)) ELSE 0 END AS shared_features,
      CASE WHEN pipelines_count > 0 THEN least(1.0::DOUBLE, complex_pipelines / pipelines_count) ELSE 0 END AS pipeline_complexity,
      least(1.0::DOUBLE, retrain_count / 4) AS retrain_frequency,
      CASE WHEN models_count > 0 AND services_count > 0 THEN least(1.0::DOUBLE, avg_impact / services_count) ELSE 0 END AS impact_radius,
      CASE WHEN services_count > 0 THEN least(1.0::DOUBLE, loops_count / (services_count * 0.3::DOUBLE)) ELSE 0 END AS feedback_loop FROM m""",
    "mes": """SELECT *, round_even(mes_raw, 2) AS mes_score, CASE WHEN mes_raw <= 3 THEN 'LOW' WHEN mes_raw <= 7 THEN 'MODERATE'
      ELSE 'CRITICAL' END AS mes_level FROM (SELECT *, (direct_calls * 0.25::DOUBLE + shared_features * 0.2::DOUBLE
        + pipeline_complexity * 0.15::DOUBLE + retrain_frequency * 0.2::DOUBLE + impact_radius * 0.1::DOUBLE
        + feedback_loop * 0.1::DOUBLE) * 10 AS mes_raw FROM mc)""",
    "maint": """SELECT *, round_even(greatest(0.0::DOUBLE, 10.0::DOUBLE
        - CASE WHEN commit_count > 1000 THEN 2 WHEN commit_count > 500 THEN 1 ELSE 0 END
        - CASE WHEN bug_rate > 0.3::DOUBLE THEN 3 WHEN bug_rate > 0.2::DOUBLE THEN 2 WHEN bug_rate > 0.1::DOUBLE THEN 1 ELSE 0 END
        - CASE WHEN avg_change_impact > 10 THEN 2 WHEN avg_change_impact > 5 THEN 1 ELSE 0 END
        - CASE WHEN top20_changes > 0 AND top5_changes / top20_changes > 0.5::DOUBLE THEN 1 ELSE 0 END), 1) AS maintainability_score,
      concat_ws('|', CASE WHEN commit_count > 1000 THEN 'Very high code churn' WHEN commit_count > 500 THEN 'High code churn' END,
        CASE WHEN bug_rate > 0.3::DOUBLE THEN 'Very high bug rate' WHEN bug_rate > 0.2::DOUBLE THEN 'High bug rate'
          WHEN bug_rate > 0.1::DOUBLE THEN 'Moderate bug rate' END,
        CASE WHEN avg_change_impact > 10 THEN 'Changes affect many files' WHEN avg_change_impact > 5 THEN 'Moderate change impact' END,
        CASE WHEN top20_changes > 0 AND top5_changes / top20_changes > 0.5::DOUBLE THEN 'Changes concentrated in few files' END) AS factors
      FROM MAINT_INPUT""",
    "valid": """SELECT *, round_even(greatest(70.0::DOUBLE, least(99.4::DOUBLE,
        0.95::DOUBLE * 100 * 0.7::DOUBLE + combined * 20 + least(services_count * 2, 10))), 1) AS accuracy_rate,
      round_even(iso, 2) AS avg_isolated_mes, round_even(non, 2) AS avg_non_isolated_mes,
      CASE WHEN iso > 0 THEN round_even(non / iso, 2) ELSE 'inf'::DOUBLE END AS degradation_ratio,
      CASE WHEN iso > 0 THEN round_even(non / iso, 2) > 3 ELSE true END AS hypothesis_confirmed
      FROM (SELECT *, round_even((mes_churn + mes_bug + mes_impact) / 3, 2) AS combined FROM (
        SELECT *, coalesce(isolated_mean, mes_score * 0.6::DOUBLE) AS iso, coalesce(non_isolated_mean, mes_score * 1.4::DOUBLE) AS non,
          STEP_CHURN AS mes_churn, STEP_BUG AS mes_bug, STEP_IMPACT AS mes_impact FROM VALID_INPUT))""",
}


def _step(y: str) -> str:
    return (
        f"CASE WHEN mes_score > 7 AND {y} > 0.7::DOUBLE THEN 0.85::DOUBLE WHEN mes_score > 5 AND {y} > 0.5::DOUBLE THEN 0.65::DOUBLE "
        f"WHEN mes_score > 3 AND {y} > 0.3::DOUBLE THEN 0.45::DOUBLE ELSE 0.25::DOUBLE END"
    )


CTES["maint"] = CTES["maint"].replace("MAINT_INPUT", "m")
CTES["valid"] = (
    CTES["valid"].replace("STEP_CHURN", _step("least(1.0::DOUBLE, commit_count / 1000)"))
    .replace("STEP_BUG", _step("bug_rate"))
    .replace("STEP_IMPACT", _step("least(1.0::DOUBLE, avg_change_impact / 10)"))
    .replace("VALID_INPUT", "mes")
)
# the wide project row of the tiers, from the pieces above
CTES["project_rows"] = """SELECT s.project_id, s.n AS services_count, coalesce(mf.n, 0) AS models_count, coalesce(p.n, 0) AS pipelines_count,
  coalesce(c.n, 0) AS direct_count, coalesce(c.n, 0) / s.n AS direct_ratio, coalesce(h.n, 0) AS hidden_count,
  coalesce(x.n, 0) AS complex_pipelines, coalesce(r.n, 0) AS retrain_count, coalesce(l.n, 0) AS loops_count,
  coalesce(sh.n, 0) AS shared_count, coalesce(g.ratio, 0) AS glue_ratio, coalesce(i.a, 0) AS avg_impact
  FROM (SELECT project_id, count(*) AS n FROM svc GROUP BY ALL) s
  LEFT JOIN (SELECT project_id, count(*) AS n FROM models GROUP BY ALL) mf USING (project_id)
  LEFT JOIN (SELECT project_id, count(*) AS n FROM pipes GROUP BY ALL) p USING (project_id)
  LEFT JOIN (SELECT project_id, count(*) AS n FROM calls GROUP BY ALL) c USING (project_id)
  LEFT JOIN (SELECT project_id, count(*) AS n FROM hidden GROUP BY ALL) h USING (project_id)
  LEFT JOIN (SELECT project_id, count(*) AS n FROM cplx WHERE is_complex GROUP BY ALL) x USING (project_id)
  LEFT JOIN (SELECT project_id, count(*) AS n FROM retrain GROUP BY ALL) r USING (project_id)
  LEFT JOIN (SELECT project_id, count(*) AS n FROM loops GROUP BY ALL) l USING (project_id)
  LEFT JOIN (SELECT project_id, count(*) AS n FROM shared GROUP BY ALL) sh USING (project_id)
  LEFT JOIN (SELECT project_id, sum(glue_lines) / sum(total_lines) AS ratio FROM glue GROUP BY ALL) g USING (project_id)
  LEFT JOIN (SELECT project_id, avg(impact_radius) AS a FROM impact GROUP BY ALL) i USING (project_id)"""
CTES["project_mc"] = CTES["mc"].replace("FROM m", "FROM project_rows")
CTES["project_mes"] = CTES["mes"].replace("FROM mc", "FROM project_mc")
CTES["model_impact"] = """SELECT n.project_id, n.model, count(m.path) AS impact FROM model_names n
  LEFT JOIN mentions m ON m.project_id = n.project_id AND m.model = n.model AND NOT m.ignored
    AND m.extension IN ('.py', '.js', '.java') GROUP BY ALL"""
CTES["recent_rate"] = f"""SELECT project_id, count(*) AS commits,
  count(*) FILTER ({contains_any('lower(message)', rules.BUG_KEYWORDS)}) AS bug_count FROM commits
  WHERE committed_at >= TIMESTAMP '2001-02-01' GROUP BY ALL"""
CTES["maint_rows"] = """SELECT c.project_id, c.n AS commit_count, coalesce(b.bug_count, 0) AS bug_count,
  coalesce(b.bug_count / b.commits, 0) AS bug_rate, coalesce(t.top5, 0) AS top5_changes, coalesce(t.top20, 0) AS top20_changes,
  coalesce(i.a, 0) AS avg_change_impact, coalesce(i.m, 0) AS max_change_impact
  FROM (SELECT project_id, count(*) AS n FROM commits GROUP BY ALL) c
  LEFT JOIN recent_rate b USING (project_id)
  LEFT JOIN (SELECT project_id, CAST(sum(changes) FILTER (rank <= 5) AS BIGINT) AS top5, CAST(sum(changes) AS BIGINT) AS top20
    FROM ranked WHERE rank <= 20 GROUP BY ALL) t USING (project_id)
  LEFT JOIN (SELECT project_id, avg(impact) AS a, max(impact) AS m FROM model_impact GROUP BY ALL) i USING (project_id)"""
CTES["project_maint"] = CTES["maint"].replace("FROM m", "FROM maint_rows")


def sql(select: str) -> str:
    """Prefix a SELECT with the expressions it uses, in dependency order."""
    order: list[str] = []

    def need(body: str) -> None:
        for name in CTES:
            if name not in order and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", body):
                need(CTES[name])
                order.append(name)

    need(select)
    if not order:
        return select
    parts = [f"{name} AS MATERIALIZED ({CTES[name]})" for name in order]
    return "WITH " + ",\n".join(parts) + "\n" + select


def oracle(name: str, select: str) -> None:
    ORACLES[name] = sql(select)


def r6(x: str, name: str | None = None) -> str:
    return f"round({x}, 6) AS {name or x}"


STAMP = "'%Y-%m-%d %H:%M:%S'"

# --- inventory
oracle("file_inventory", "SELECT project_id, path, dir, name, extension, size, ignored, name_ignored FROM tree")
oracle("find_files", "SELECT project_id, path FROM tree WHERE regexp_matches(name, '^[^/]*_[^/]*\\.py$')")
oracle("language_counts", "SELECT project_id, language, count(*) AS files FROM lang1 GROUP BY ALL")
oracle("language_counts_scanner", "SELECT project_id, language, count(*) AS files FROM lang2 GROUP BY ALL")
oracle("primary_language", """SELECT p.project_id, coalesce(b.language, 'Unknown') AS language FROM (SELECT DISTINCT project_id FROM tree) p
  LEFT JOIN (SELECT project_id, language, row_number() OVER (PARTITION BY project_id ORDER BY n DESC, ord) AS rn FROM (
    SELECT project_id, language, count(*) AS n FROM lang1 GROUP BY ALL) JOIN lang1_order USING (language)) b
  ON b.project_id = p.project_id AND b.rn = 1""")
oracle("language_hits", "SELECT project_id, path, language FROM lang3")
oracle("language_stats", "SELECT project_id, language, count(*) AS files FROM lang3 GROUP BY ALL")
TOP_SHARE = """SELECT project_id, language, files, total_files, round_even(files / total_files * 100, 1) AS percentage FROM (
  SELECT project_id, language, n AS files, row_number() OVER (PARTITION BY project_id ORDER BY n DESC, ord) AS rn FROM (
    SELECT project_id, language, count(*) AS n FROM lang3 GROUP BY ALL) JOIN lang_order USING (language))
  JOIN (SELECT project_id, count(*) AS total_files FROM tree GROUP BY ALL) USING (project_id) WHERE rn = 1"""
oracle("primary_language_share", TOP_SHARE)
TYPE_ROWS = [(i, t, p, p.rstrip("/"), p.endswith("/")) for i, (t, ps) in enumerate(rules.PROJECT_TYPE_PATTERNS.items()) for p in ps]
CTES["types1"] = f"""SELECT project_id, ord, project_type, CAST(sum(n) AS BIGINT) AS score FROM (
  SELECT t.project_id, r.ord, r.project_type, count(*) FILTER (NOT t.ignored AND contains(t.path, r.p))
    + 2 * CAST(bool_or(starts_with(t.path, r.base || '/') OR (NOT r.slash AND t.path = r.p)) AS INTEGER) AS n
  FROM tree t, {values(TYPE_ROWS).replace('True', 'true').replace('False', 'false')} r(ord, project_type, p, base, slash)
  GROUP BY t.project_id, r.ord, r.project_type, r.p) GROUP BY ALL HAVING sum(n) > 0"""
DTYPES = [(i, t, p) for i, (t, ps) in enumerate(rules.DETECTOR_PROJECT_TYPES.items()) for p in ps]
CTES["types2"] = f"""SELECT t.project_id, r.ord, r.project_type, count(*) AS score FROM tree t JOIN {values(DTYPES)} r(ord, project_type, p)
  ON contains(t.path, r.p) GROUP BY t.project_id, r.ord, r.project_type UNION ALL
  SELECT project_id, {len(rules.DETECTOR_PROJECT_TYPES)}, 'Full Stack', 2 FROM (SELECT DISTINCT project_id, language FROM lang3
    WHERE language IN ('Python', 'JavaScript')) GROUP BY project_id HAVING count(*) = 2"""
BEST = """SELECT p.project_id, coalesce(b.project_type, 'Unknown') AS project_type, coalesce(b.score, 0) AS score
  FROM (SELECT DISTINCT project_id FROM tree) p LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY project_id
    ORDER BY score DESC, ord) AS rn FROM {}) b ON b.project_id = p.project_id AND b.rn = 1"""
oracle("project_type_scores", "SELECT project_id, project_type, score FROM types1")
oracle("project_type", BEST.format("types1"))
oracle("detector_project_type_scores", "SELECT project_id, project_type, score FROM types2")
CTES["best2"] = BEST.format("types2")
oracle("detector_project_type", "SELECT *, CASE WHEN score > 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM best2")
oracle("project_types", """SELECT t.project_id, concat_ws('|',
    CASE WHEN (SELECT count(*) FROM svc2 s WHERE s.project_id = t.project_id) > 1 THEN 'Microservices' END,
    CASE WHEN bool_or(contains(name, 'package.json')) AND bool_or(ends_with(name, '.html')) THEN 'Web Application' END,
    CASE WHEN EXISTS (SELECT 1 FROM model_files2 s WHERE s.project_id = t.project_id) OR bool_or(contains(name, 'train.py')) THEN 'Machine Learning' END,
    CASE WHEN EXISTS (SELECT 1 FROM pipes2 s WHERE s.project_id = t.project_id) OR bool_or(contains(path, 'pipeline')) THEN 'Data Pipeline' END,
    CASE WHEN bool_or(name IN ('app.py', 'main.py', 'server.js', 'api.py')) THEN 'API Service' END,
    CASE WHEN bool_or(name IN ('setup.py', '__init__.py')) THEN 'Library/Package' END) AS project_types
  FROM tree t WHERE NOT ignored GROUP BY t.project_id""")
BUILDS = values([(b, i) for b, ins in rules.BUILD_SYSTEMS.items() for i in ins])
CTES["builds"] = f"SELECT DISTINCT t.project_id, r.build_system FROM tree t JOIN {BUILDS} r(build_system, i) ON contains(t.path, r.i)"
oracle("build_systems", "SELECT * FROM builds")
oracle("categorize_files", f"""SELECT project_id, path, concat_ws('|', CASE WHEN extension IN ({qlist(rules.SCANNER_MODEL_EXTENSIONS)}) THEN 'model' END,
  CASE WHEN name IN ({qlist(rules.DOCKER_FILES)}) THEN 'docker' END,
  CASE WHEN extension IN ({qlist(rules.CONFIG_EXTENSIONS)}) THEN 'config' END) AS tags FROM tree WHERE NOT ignored""")


def human(x: str, digits: int, units, last: str) -> str:
    out, value = "CASE", f"CAST({x} AS DOUBLE)"
    for unit in units:
        out += f" WHEN {value} < 1024 THEN printf('%.{digits}f {unit}', {value})"
        value = f"{value} / 1024"
    return out + f" ELSE printf('%.{digits}f {last}', {value}) END"


LONG, SHORT = (["B", "KB", "MB", "GB", "TB"], "PB"), (["B", "KB", "MB", "GB"], "TB")
oracle("file_statistics", f"""SELECT *, round_even(total_size / 1048576, 2) AS total_size_mb, {human('total_size', 2, *LONG)} AS total_size_hr FROM (
  SELECT project_id, coalesce(nullif(extension, ''), 'no_extension') AS extension, count(*) AS total_files, CAST(sum(size) AS BIGINT) AS total_size
  FROM tree WHERE NOT ignored GROUP BY ALL UNION ALL
  SELECT project_id, 'all', count(*), CAST(sum(size) AS BIGINT) FROM tree WHERE NOT ignored GROUP BY ALL)""")
COUNTS = " ".join(
    f"LEFT JOIN (SELECT project_id, count(*) AS {n}_count FROM {c} GROUP BY ALL) USING (project_id)"
    for n, c in (("services", "svc"), ("models", "models"), ("pipelines", "pipes"))
)
oracle("inventory_counts", f"""SELECT project_id, total_files, total_size, config_files_count, docker_files_count,
  coalesce(services_count, 0) AS services_count, coalesce(models_count, 0) AS models_count, coalesce(pipelines_count, 0) AS pipelines_count FROM (
  SELECT project_id, count(*) AS total_files, CAST(sum(size) AS BIGINT) AS total_size,
    count(*) FILTER (extension IN ({qlist(rules.CONFIG_EXTENSIONS)})) AS config_files_count,
    count(*) FILTER (name IN ({qlist(rules.DOCKER_FILES)})) AS docker_files_count FROM tree WHERE NOT ignored GROUP BY ALL) {COUNTS}""")
oracle("directory_stats", f"""SELECT project_id, total_files, coalesce(d.n, 0) AS total_dirs, total_size, {human('total_size', 1, *SHORT)} AS total_size_hr
  FROM (SELECT project_id, count(*) AS total_files, CAST(sum(size) AS BIGINT) AS total_size FROM tree GROUP BY ALL)
  LEFT JOIN (SELECT project_id, count(DISTINCT owner) AS n FROM owners WHERE owner <> '.' GROUP BY ALL) d USING (project_id)""")
oracle("extreme_files", f"""SELECT project_id, list, CAST(rank AS INTEGER) AS rank, path, size, strftime(modified, {STAMP}) AS modified FROM (
  SELECT *, 'largest' AS list, row_number() OVER (PARTITION BY project_id ORDER BY size DESC, path) AS rank FROM tree UNION ALL
  SELECT *, 'newest', row_number() OVER (PARTITION BY project_id ORDER BY modified DESC, path) FROM tree UNION ALL
  SELECT *, 'oldest', row_number() OVER (PARTITION BY project_id ORDER BY modified, path) FROM tree) WHERE rank <= 10""")
oracle("directory_size", f"""SELECT project_id, CAST(sum(size) AS BIGINT) AS size FROM tree
  WHERE NOT regexp_matches(dir || '/', {q('(?:^|/)' + globs_regex(rules.SCANNER_IGNORE_GLOBS) + '(?:/|$)')}) GROUP BY ALL""")
oracle("directory_tree", """SELECT project_id, path, kind, len(string_split(path, '/')) - 1 AS depth FROM (
  SELECT DISTINCT project_id, owner AS path, 'dir' AS kind FROM owners WHERE owner <> '.' UNION ALL
  SELECT project_id, path, 'file' FROM tree) WHERE len(string_split(path, '/')) <= 4""")
oracle("file_details", f"""SELECT project_id, path, size, {human('size', 1, *SHORT)} AS size_hr, md5(content) AS hash,
  CASE WHEN {ends(rules.LINE_COUNT_CODE)} THEN len(string_split(content, chr(10))) - CASE WHEN content = '' OR ends_with(content, chr(10)) THEN 1 ELSE 0 END
  ELSE -1 END AS lines FROM tree WHERE NOT ignored""")
# --- services and pipelines
oracle("detect_services", "SELECT * FROM svc")
oracle("detect_services_scanner", "SELECT project_id, name, path, language, indicators FROM svc2")
oracle("files_in_services", "SELECT * FROM svc_files")
oracle("detect_pipelines", "SELECT * FROM pipes")
oracle("detect_pipelines_scanner", "SELECT * FROM pipes2")
for name, found, code in (("pipeline_files", "pipes", rules.PIPELINE_CODE), ("pipeline_files_scanner", "pipes2", rules.SCANNER_PIPELINE_CODE)):
    oracle(name, f"""SELECT p.project_id, p.name, p.path, CASE WHEN p.path = '.' THEN t.path ELSE substr(t.path, length(p.path) + 2) END AS file
  FROM {found} p JOIN tree t ON t.project_id = p.project_id AND (p.path = '.' OR starts_with(t.path, p.path || '/')) AND {ends(code, 't.name')}""")
oracle("pipeline_complexity", "SELECT project_id, name, path, stages, round(branching_factor, 6) AS branching_factor, round(stages * branching_factor, 6) AS complexity, is_complex FROM cplx")
oracle("pipeline_complexity_scanner", """SELECT p.project_id, p.name, p.path, p.stages, round_even(1.0::DOUBLE
  + coalesce(sum(f.flow_words + f.defs * 2 + CAST(f.mentions_branching AS INTEGER) * 5), 0) / 10, 2) AS complexity
  FROM pipes2 p LEFT JOIN feat f ON f.project_id = p.project_id AND f.is_python AND (p.path = '.' OR starts_with(f.path, p.path || '/'))
  GROUP BY p.project_id, p.name, p.path, p.stages""")
oracle("compose_attach", """SELECT s.project_id, s.name, s.path, c.name AS compose_name, c.image, c.mounts AS model_mounts
  FROM svc s JOIN compose c ON c.project_id = s.project_id AND (c.name = s.name OR contains(s.path, c.name))""")
# --- models
oracle("detect_model_files", f"SELECT project_id, name, path, type, size, strftime(modified, {STAMP}) AS modified, 'file_extension' AS detected_by FROM model_files")
oracle("detect_model_files_scanner", "SELECT project_id, name, path, type, size FROM model_files2")
oracle("model_file_facts", "SELECT * FROM facts")
oracle("detect_model_code_refs", "SELECT project_id, name, path, 'Inferred' AS type, 'code_reference' AS detected_by, context FROM code_refs")
oracle("model_references", "SELECT * REPLACE (coalesce(model_reference, '') AS model_reference) FROM refs")
oracle("model_metadata_files", "SELECT * FROM metadata")
oracle("model_detection_stats", """SELECT p.project_id, count(DISTINCT f.path) AS total_models,
  coalesce((SELECT CAST(sum(CAST(size_mb AS DECIMAL(18,2))) AS DOUBLE) FROM facts x WHERE x.project_id = p.project_id), 0) AS total_size_mb,
  (SELECT count(*) FROM refs r WHERE r.project_id = p.project_id) AS total_references,
  (SELECT count(*) FROM refs r WHERE r.project_id = p.project_id AND kind = 'loading') AS loading_references,
  (SELECT count(*) FROM refs r WHERE r.project_id = p.project_id AND kind = 'prediction') AS prediction_references,
  (SELECT count(*) FROM refs r WHERE r.project_id = p.project_id AND kind = 'training') AS training_references,
  (SELECT count(*) FROM metadata r WHERE r.project_id = p.project_id) AS metadata_files
  FROM (SELECT project_id FROM facts UNION SELECT project_id FROM refs UNION SELECT project_id FROM metadata) p
  LEFT JOIN facts f USING (project_id) GROUP BY p.project_id""")
oracle("model_frameworks", "SELECT project_id, framework, count(*) AS models FROM facts GROUP BY ALL")
oracle("missing_models", "SELECT project_id, path, line, framework, pattern, model_reference FROM missing")
oracle("model_issues", """SELECT project_id, 'large_model' AS type, 'warning' AS severity, path AS file, name AS model,
  'Model ' || name || ' is ' || CAST(round_even(size * 100000 / 1048576, 2) AS VARCHAR) || 'MB, consider optimization' AS message
  FROM facts WHERE round_even(size * 100000 / 1048576, 2) > 100
  UNION ALL SELECT project_id, 'missing_model', 'critical', path, model_reference, 'Model ' || model_reference || ' referenced but not found' FROM missing""")
SCAN_PARTS = []
for o, p in enumerate(rules.SCANNER_REFERENCE_PATTERNS):
    g = 1 if "(" in p.replace(r"\(", "").replace("(?:", "") else 0
    # position of the i-th hit: everything before it, by cutting off each earlier one
    SCAN_PARTS.append(f"""SELECT project_id, path AS file, {o} AS o, i, hits[i] AS hit, regexp_extract(hits[i], {q(p)}, {g}) AS ref, content, hits
      FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT project_id, path, content, regexp_extract_all(content, {q(p)}) AS hits
        FROM tree WHERE {ends(['.py', '.ipynb', '.r', '.R', '.js'])}))""")
CTES["scan_refs"] = f"""WITH RECURSIVE h AS (SELECT *, row_number() OVER () AS id FROM ({' UNION ALL '.join(SCAN_PARTS)})),
  walk AS (SELECT id, 0 AS step, 0 AS pos FROM h UNION ALL
    SELECT w.id, w.step + 1, w.pos + strpos(substr(h.content, w.pos + 1), h.hits[w.step + 1]) - 1
      + CASE WHEN w.step + 1 < h.i THEN length(h.hits[w.step + 1]) ELSE 0 END
    FROM walk w JOIN h ON h.id = w.id WHERE w.step < h.i)
  SELECT h.project_id, h.file, h.o, h.i, h.ref, len(string_split(left(h.content, w.pos), chr(10))) AS line,
    trim(replace(substr(h.content, greatest(w.pos - 50, 0) + 1, w.pos + 50 - greatest(w.pos - 50, 0)), chr(10), ' '), ' ') AS context
  FROM h JOIN walk w ON w.id = h.id AND w.step = h.i"""
oracle("model_code_refs_merge", """SELECT r.project_id, CASE WHEN m.path IS NULL THEN string_split(r.ref, '/')[-1] ELSE m.name END AS name,
  coalesce(m.path, r.ref) AS path, CASE WHEN m.path IS NULL THEN 'Inferred' ELSE m.type END AS type, r.file AS consumer_file, r.line, r.context,
  m.path IS NULL AS inferred FROM scan_refs r LEFT JOIN model_files2 m ON m.project_id = r.project_id AND m.path = (
    SELECT min(x.path) FROM model_files2 x WHERE x.project_id = r.project_id AND (contains(r.ref, x.name) OR contains(x.path, r.ref)))""")
# --- endpoints
oracle("detect_endpoints", "SELECT * FROM eps")
oracle("service_dependencies", "SELECT * FROM deps")
oracle("dependency_graph_nodes", """SELECT s.project_id, s.name, 'service' AS type, arg_max(s.language, s.path) AS service_type,
  arg_max(s.n, s.path) AS endpoints FROM (SELECT s.*, (SELECT count(*) FROM eps e WHERE e.project_id = s.project_id AND e.service_path = s.path) AS n FROM svc s) s
  GROUP BY s.project_id, s.name""")
oracle("dependency_graph_edges", "SELECT project_id, source, target, 'http_call' AS type FROM deps")
oracle("key_counts", """SELECT s.project_id, (SELECT count(*) FROM eps e WHERE e.project_id = s.project_id) AS endpoint_count,
  count(DISTINCT s.name) AS dependency_count FROM svc s GROUP BY s.project_id""")
# --- frameworks and manifests
MANIFEST = values([(fw, w) for fw, ws in rules.MANIFEST_FRAMEWORKS.items() for w in ws])
CTES["mani"] = f"""SELECT DISTINCT t.project_id, r.framework FROM tree t JOIN {MANIFEST} r(framework, w) ON contains(t.content, r.w)
  WHERE NOT t.ignored AND t.name IN ({qlist(rules.MANIFEST_NAMES)})"""
oracle("manifest_frameworks", "SELECT * FROM mani")
oracle("code_frameworks", " UNION ".join(
    f"SELECT project_id, {q(fw)} AS framework FROM tree WHERE {ends(rules.CODE_FRAMEWORK_CODE)} AND "
    + any_of(f"regexp_matches(content, {q('(?i)' + p)})" for p in ps)
    for fw, ps in rules.CODE_FRAMEWORKS.items()
))
oracle("framework_evidence", "SELECT * FROM evid")
oracle("detect_frameworks_from_files", "SELECT * FROM fw_files")
oracle("detect_frameworks_from_dependencies", "SELECT * FROM fw_deps")
oracle("detect_frameworks_all", "SELECT * FROM fw_all")
oracle("frameworks_by_category", "SELECT project_id, category, string_agg(framework || ':' || confidence, '|' ORDER BY confidence DESC, framework) AS frameworks FROM fw_all GROUP BY ALL")
oracle("framework_report", """SELECT project_id, count(*) AS total_frameworks, coalesce(array_to_string((list(framework ORDER BY confidence DESC, framework)
  FILTER (confidence >= 5))[1:5], '|'), '') AS primary_frameworks FROM fw_all GROUP BY ALL""")
oracle("parse_requirements", "SELECT project_id, path, requirement, package FROM reqs")
oracle("parse_package_json", "SELECT project_id, path, package, version FROM packages")
oracle("dependency_manifests", """SELECT project_id, dir, type, file, entries FROM (SELECT *, row_number() OVER (PARTITION BY project_id, dir ORDER BY pri DESC) AS rn FROM (
  SELECT project_id, dir, 'pip' AS type, path AS file, count(requirement) AS entries, 1 AS pri FROM
    (SELECT project_id, dir, path FROM tree WHERE name = 'requirements.txt') LEFT JOIN reqs USING (project_id, dir, path) GROUP BY ALL
  UNION ALL SELECT project_id, dir, 'npm', path, count(*), 2 FROM packages GROUP BY project_id, dir, path
  UNION ALL SELECT project_id, dir, 'maven', path, 0, 3 FROM tree WHERE name = 'pom.xml')) WHERE rn = 1""")
POLYGLOT = {
    "services": "detect_services", "endpoints": "detect_endpoints", "manifests": "dependency_manifests",
    "frameworks": "detect_frameworks_from_dependencies",
}
for name, same in POLYGLOT.items():
    ORACLES[f"polyglot_{name}"] = ORACLES[same].replace(corpus.PATH, corpus.POLYGLOT_PATH).replace(
        code_sql("text"), code_sql("text", corpus.POLYGLOT_WORDS)
    )
# --- smells
oracle("direct_model_calls", "SELECT * FROM calls")
CTES["call_sum"] = """SELECT s.project_id, count(*) AS services_count, (SELECT count(*) FROM calls c WHERE c.project_id = s.project_id) AS direct_count
  FROM svc s GROUP BY s.project_id"""
oracle("direct_model_call_summary", "SELECT *, round(direct_count / services_count, 6) AS direct_ratio FROM call_sum")
RULES = [("loading", p) for p in rules.LOADING_PATTERNS] + [("prediction", p) for p in rules.PREDICTION_PATTERNS]
DETAIL = " UNION ALL ".join(
    f"SELECT project_id, path, {o} AS o, {q(kind)} AS pattern, line, trim(code, ' ') AS code, unnest(range({count_sql('code', p)})) AS occ "
    f"FROM src_lines JOIN gates USING (project_id, path) WHERE {ends(rules.MODEL_CALL_CODE)} AND contains(code, {q(literal_of(p))})" + (" AND gated" if kind == "prediction" else "")
    for o, (kind, p) in enumerate(RULES)
)
CTES["gates"] = f"SELECT project_id, path, {contains_any('content', rules.PREDICTION_GATE)} AS gated FROM tree"
CTES["detail"] = DETAIL
oracle("direct_model_call_details", """SELECT project_id, service, service_path, CAST(rank AS INTEGER) AS rank, file, line, pattern, code FROM (
  SELECT s.project_id, s.name AS service, s.path AS service_path, CASE WHEN s.path = '.' THEN d.path ELSE substr(d.path, length(s.path) + 2) END AS file,
    d.line, d.pattern, d.code, row_number() OVER (PARTITION BY s.project_id, s.path ORDER BY d.path, d.o, d.line, d.occ) AS rank
  FROM svc s JOIN detail d ON d.project_id = s.project_id AND (s.path = '.' OR starts_with(d.path, s.path || '/'))) WHERE rank <= 5""")
oracle("glue_code_by_service", "SELECT *, round(glue_lines / total_lines, 6) AS ratio FROM glue")
GLUE_SUM = """SELECT project_id, CAST(sum(glue_lines) AS BIGINT) AS glue_lines, CAST(sum(total_lines) AS BIGINT) AS total_lines,
  round(sum(glue_lines) / sum(total_lines), 6) AS glue_ratio FROM {} GROUP BY ALL"""
oracle("glue_code_ratio", GLUE_SUM.format("glue"))
oracle("glue_code_literal_mode", GLUE_SUM.format("glue_lit"))
oracle("declared_consumers", "SELECT * FROM declared")
oracle("actual_consumers", "SELECT * FROM actual")
oracle("hidden_consumers", "SELECT * FROM hidden")
oracle("impact_radius", "SELECT * FROM impact")
oracle("retrain_events", "SELECT * FROM retrain")
oracle("feedback_loops", "SELECT * FROM loops")
oracle("feature_imports", "SELECT * FROM imps")
oracle("shared_features", "SELECT * FROM shared")
oracle("service_model_matrix", """SELECT DISTINCT s.project_id, s.name AS service, m.model, 1 AS depends FROM mentions m JOIN svc s
  ON s.project_id = m.project_id AND (s.path = '.' OR starts_with(m.path, s.path || '/'))""")
# --- history
oracle("recent_commits", f"""SELECT project_id, commit_id, author, strftime(committed_at, {STAMP}) AS committed_at, message FROM commits
  WHERE committed_at >= TIMESTAMP '2001-08-01' - INTERVAL 180 DAY""")
oracle("bug_fix_commits", f"SELECT * REPLACE (strftime(committed_at, {STAMP}) AS committed_at) FROM bugs")
oracle("file_history", "SELECT project_id, commit_id, author, message FROM commits JOIN cfiles USING (project_id, commit_id) WHERE path = 'svc1/models/model_1.pkl'")
oracle("changed_files", "SELECT project_id, path FROM cfiles WHERE commit_id = '77'")
CTES["info"] = f"""SELECT project_id, count(*) AS commit_count, count(DISTINCT author) AS contributors_count,
  strftime(min(committed_at), {STAMP}) AS created_at FROM commits GROUP BY ALL"""
oracle("repo_info", """SELECT i.*, l.commit_id AS last_commit_id, l.author AS last_author, l.message AS last_message FROM info i JOIN (
  SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY committed_at DESC, commit_id DESC) AS rn FROM commits) l
  ON l.project_id = i.project_id AND l.rn = 1""")
oracle("contributors", "SELECT project_id, author, count(*) AS commits FROM commits GROUP BY ALL")
oracle("commits_by_author", "SELECT project_id, author, count(*) AS commits FROM ecommits GROUP BY ALL")
oracle("commits_by_date", "SELECT project_id, strftime(committed_at, '%Y-%m-%d') AS date, count(*) AS commits FROM ecommits GROUP BY ALL")
oracle("churn_by_file", "SELECT project_id, path, changes, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 50")
oracle("top_changed_files", "SELECT project_id, path, changes, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 20")
oracle("churn_by_service", """SELECT s.project_id, s.name AS service, s.path, CAST(coalesce(sum(c.changes), 0) AS BIGINT) AS churn FROM svc s
  LEFT JOIN changes c ON c.project_id = s.project_id AND (s.path = '.' OR starts_with(c.path, s.path || '/')) GROUP BY ALL""")
CTES["windowed"] = """SELECT f.*, c.author, strftime(c.committed_at, '%Y-%m-%d') AS date FROM cfiles f JOIN commits c USING (project_id, commit_id)
  WHERE c.committed_at >= TIMESTAMP '2001-08-01' - INTERVAL 180 DAY"""
oracle("churn_lines", " UNION ALL ".join(
    f"SELECT project_id, {key} AS key, '{level}' AS level, CAST(sum(added) AS BIGINT) AS added, CAST(sum(deleted) AS BIGINT) AS deleted, "
    f"count(DISTINCT commit_id) AS commits FROM windowed GROUP BY 1, 2, 3"
    for key, level in (("path", "file"), ("author", "author"), ("date", "date"), ("'all'", "total"))
))
oracle("bug_rate", "SELECT *, round(bug_count / commits, 6) AS bug_rate FROM recent_rate")
oracle("bug_rate_all_events", f"""SELECT project_id, count(*) AS commits, count(*) FILTER ({contains_any('lower(message)', rules.BUG_KEYWORDS)}) AS bug_count,
  round(count(*) FILTER ({contains_any('lower(message)', rules.BUG_KEYWORDS)}) / count(*), 6) AS bug_rate FROM ecommits GROUP BY ALL""")
oracle("bug_prone_files", """SELECT project_id, path, bugs, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY bugs DESC, path) AS rank FROM (
  SELECT f.project_id, f.path, count(*) AS bugs FROM cfiles f JOIN (SELECT * FROM bugs
    WHERE committed_at >= TIMESTAMP '2001-02-01') b USING (project_id, commit_id) GROUP BY ALL)) WHERE rank <= 20""")
oracle("change_concentration", """SELECT project_id, CAST(coalesce(sum(changes) FILTER (rank <= 5), 0) AS BIGINT) AS top5_changes, CAST(sum(changes) AS BIGINT) AS top20_changes
  FROM ranked WHERE rank <= 20 GROUP BY ALL""")
oracle("estimate_churn", """SELECT project_id, path, CAST(1 AS BIGINT) AS changes, CAST(rank AS INTEGER) AS rank, commit_count FROM (
  SELECT project_id, path, row_number() OVER (PARTITION BY project_id ORDER BY path) AS rank, count(*) OVER (PARTITION BY project_id) AS commit_count
  FROM tree WHERE NOT ignored) WHERE rank <= 20""")
oracle("estimate_bugs", """SELECT project_id, CAST(sum(CAST(bug_name AS INTEGER) + todos) AS BIGINT) AS bug_count,
  round(sum(CAST(bug_name AS INTEGER) + todos) / count(*), 6) AS bug_rate FROM feat WHERE NOT ignored GROUP BY ALL""")
oracle("estimate_bug_prone_files", """SELECT project_id, path, bugs, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY bugs DESC, path) AS rank FROM (
  SELECT project_id, path, CAST(CAST(bug_name AS INTEGER) + CAST(bug_marker AS INTEGER) AS BIGINT) AS bugs FROM feat WHERE NOT ignored) WHERE bugs > 0) WHERE rank <= 20""")
oracle("change_impact_by_model", "SELECT * FROM model_impact")
oracle("change_impact", "SELECT project_id, round(avg(impact), 6) AS avg_change_impact, max(impact) AS max_change_impact FROM model_impact GROUP BY ALL")
oracle("bugs_by_model", """SELECT m.project_id, m.name AS model, count(DISTINCT b.commit_id) AS bugs FROM (SELECT DISTINCT project_id, name FROM model_files) m
  JOIN cfiles f ON f.project_id = m.project_id AND contains(f.path, m.name) JOIN bugs b ON b.project_id = f.project_id AND b.commit_id = f.commit_id
  WHERE b.committed_at >= TIMESTAMP '2001-02-01' GROUP BY ALL""")
oracle("commit_log_commits", f"SELECT project_id, commit_id, author, strftime(committed_at, {STAMP}) AS committed_at, message FROM commits WHERE EXISTS (SELECT 1 FROM clines l WHERE l.commit_id = commits.commit_id)")
oracle("commit_log_files", """SELECT project_id, commit_id, path, CAST(sum(CASE WHEN added % 10 = 0 THEN 0 ELSE added END) AS BIGINT) AS added,
  CAST(sum(deleted) AS BIGINT) AS deleted, count(*) AS rows FROM clines JOIN commits USING (project_id, commit_id) GROUP BY ALL""")
oracle("commit_log_lines", "SELECT project_id, commit_id, path, added, deleted FROM cfiles")
# --- repositories
oracle("search_repositories", """SELECT id, full_name, description, stars, forks, array_to_string(topics, '|') AS topics FROM repos
  WHERE (contains(full_name, 'nation_1') OR contains(description, 'nation_1')) AND list_contains(topics, 'kubernetes') ORDER BY stars DESC, id LIMIT 20""")
oracle("search_repositories_by_forks", "SELECT id, full_name, description, stars, forks, array_to_string(topics, '|') AS topics FROM repos ORDER BY forks, id LIMIT 25")
for name, topics in (("ranked_ml_repositories", rules.ML_TOPICS), ("ranked_microservice_repositories", rules.MICROSERVICE_TOPICS)):
    oracle(name, f"""SELECT id, full_name, stars, topic FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) AS k FROM (
      SELECT r.*, v.topic, v.ord, row_number() OVER (PARTITION BY v.topic ORDER BY r.stars DESC, r.id) AS rn FROM repos r
      JOIN {values([(t, i) for i, t in enumerate(topics)])} v(topic, ord) ON list_contains(r.topics, v.topic)))
      WHERE k = 1 ORDER BY stars DESC, id LIMIT 20""")
oracle("language_byte_share", """SELECT id, language, bytes, round_even(bytes / total * 100, 1) AS percentage FROM (
  SELECT l_suppkey AS id, p_type AS language, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS bytes,
    sum(sum(CAST(l_quantity AS BIGINT))) OVER (PARTITION BY l_suppkey) AS total FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)""")
oracle("top_contributors", """SELECT id, login, contributions, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY contributions DESC, login) AS rank FROM (
  SELECT l_suppkey AS id, 'dev' || (l_orderkey % 97) AS login, count(*) AS contributions FROM lineitem GROUP BY 1, 2)) WHERE rank <= 10""")
oracle("latest_releases", f"""SELECT id, tag, strftime(published, {STAMP}) AS published, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY published DESC, tag) AS rank FROM (
  SELECT l_suppkey AS id, 'v' || l_partkey AS tag, max(l_shipdate) AS published FROM lineitem GROUP BY 1, 2)) WHERE rank <= 5""")
oracle("repositories_from_json", """SELECT s_suppkey AS id, 'org/' || s_name AS full_name, CASE WHEN s_suppkey % 4 <> 0 THEN lower(s_name) ELSE 'No description' END AS description,
  CAST(floor(s_acctbal) AS BIGINT) AS stars, CAST(0 AS BIGINT) AS forks, CASE WHEN s_suppkey % 3 <> 0 THEN 'Python' ELSE 'Unknown' END AS language,
  'main' AS default_branch, CASE WHEN s_suppkey % 5 <> 0 THEN 'docker|mlops' ELSE '' END AS topics,
  CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'unknown' END AS owner_login FROM supplier""")
RX = r"github\.com[/:]([^/]+)/([^/]+?)(?:\.git)?$"
oracle("repo_url_parts", f"""SELECT page_id, repo_url, regexp_extract(repo_url, {q(RX)}, 1) AS owner, replace(regexp_extract(repo_url, {q(RX)}, 2), '.git', '') AS repo FROM (
  SELECT page_id, CASE WHEN page_id % 11 = 0 THEN url ELSE CASE WHEN page_id % 3 = 0 THEN 'git@github.com:' ELSE 'https://github.com/' END
    || 'org' || (page_id % 7) || '/' || string_split(url, '/')[3] || CASE WHEN page_id % 2 = 0 THEN '.git' ELSE '' END END AS repo_url FROM pages)""")
# --- MLOps
oracle("kubeflow_items", """SELECT DISTINCT 'pipeline' AS kind, CAST(user_id AS VARCHAR) AS id, 'p' || user_id AS name, 'pipelines/pipeline_' || user_id || '.yaml' AS file FROM events
  UNION ALL SELECT DISTINCT 'experiment', event_type, 'x', 'experiments/experiment_' || event_type || '.json' FROM events
  UNION ALL SELECT 'run', CAST(event_id AS VARCHAR), 'r', 'pipelines/pipeline_' || user_id || '_runs.json' FROM events""")
oracle("mlflow_runs", """SELECT CAST(event_id AS VARCHAR) AS run_id, event_type AS experiment_id, start_time, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY start_time DESC, CAST(event_id AS VARCHAR)) AS rank FROM (
    SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS start_time FROM events))""")
ML_COUNTS = """SELECT count(DISTINCT event_type) AS experiments, (SELECT CAST(count(*) AS BIGINT) FROM events) AS runs,
  count(DISTINCT user_id) AS models FROM events"""
CTES["mlc"] = ML_COUNTS
oracle("mlflow_item_counts", "SELECT 'experiments' AS kind, experiments AS items FROM mlc UNION ALL SELECT 'runs', runs FROM mlc UNION ALL SELECT 'models', models FROM mlc")
oracle("bentoml_items", """SELECT DISTINCT 'bento' AS kind, event_type AS name, CAST(user_id AS VARCHAR) AS version FROM events
  UNION ALL SELECT DISTINCT 'model', 'm-' || event_type, CAST(user_id AS VARCHAR) FROM events""")
oracle("seldon_models", "SELECT 'd' || event_id AS deployment, event_type AS namespace, 'g' || user_id AS model, 'main' AS predictor FROM events")
oracle("collection_manifest", "SELECT 'mlflow' AS platform, 'http://mlflow.example' AS endpoint, '2024-01-31T00:00:00' AS collection_time, 'out' AS target_path, * FROM mlc")
COUNTS = {
    "kubeflow": "count(DISTINCT user_id) AS pipelines, count(DISTINCT event_type) AS experiments",
    "bentoml": "count(DISTINCT (event_type, user_id)) AS bentos, count(DISTINCT (event_type, user_id)) AS models",
    "seldon": "count(DISTINCT event_id) AS deployments",
}
for platform, counts in COUNTS.items():
    kinds = re.findall(r"AS (\w+)", counts)
    oracle(f"{platform}_item_counts", " UNION ALL ".join(f"SELECT '{k}' AS kind, {k} AS items FROM (SELECT {counts} FROM events)" for k in kinds))
    oracle(f"{platform}_manifest", f"""SELECT '{platform}' AS platform, 'http://{platform}.example' AS endpoint,
      '2024-01-31T00:00:00' AS collection_time, 'out' AS target_path, {counts} FROM events""")
oracle("quarantined_payloads", """SELECT CASE kind WHEN 0 THEN '' WHEN 1 THEN left(payload, length(payload) - 1) ELSE '[1]' END AS payload,
  CASE kind WHEN 0 THEN 'missing' WHEN 1 THEN 'not JSON' ELSE 'not an object' END AS reason FROM (
  SELECT payload, length(payload) % 5 AS kind FROM (SELECT '{"pipelines":[{"id":"' || user_id || '","name":"p' || user_id || '"}],"experiments":[{"id":"'
    || event_type || '","name":"x"}],"runs":[{"id":"' || event_id || '","pipeline_id":"' || user_id || '","name":"r"}]}' AS payload FROM events))
  WHERE kind <= 2""")
# --- text functions, archives, sinks
README = "CASE WHEN length(text) > 1000 THEN left(text, 1000) || '...' ELSE text END"
oracle("text_functions", f"""SELECT doc_id, {human('n_chars * n_chars * 37', 2, *LONG)} AS size_long, {human('n_chars * n_chars * 37', 1, *SHORT)} AS size_short,
  len(string_split(text, chr(10))) - CASE WHEN text = '' OR ends_with(text, chr(10)) THEN 1 ELSE 0 END AS lines,
  length({README}) AS readme_length, md5({README}) AS readme_hash, sha256(text) AS sha256 FROM documents""")
oracle("safe_filenames", """SELECT page_id, CASE WHEN length(s) > 255 THEN left(s, 250) || '.html' ELSE s END AS safe FROM (
  SELECT page_id, regexp_replace(url || ':' || regexp_replace(html, '[^A-Za-z ]', '', 'g') || '.html', '[<>:"/\\\\|?*]', '_', 'g') AS s FROM pages)""")
oracle("fenced_json", """SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN '{"turn": ' || turn || ', "role": "' || role || '"}' ELSE '{"turn": ' || turn || '}' END AS body,
  turn AS parsed_turn FROM conversations""")
_PATH_IGNORED = q("(^|/)" + globs_regex(rules.IGNORE_GLOBS) + "(/|$)")
oracle("scan_files", f"""SELECT project_id, path, octet_length(encode(text)) AS size,
  CASE WHEN ends_with(path, '.pkl') THEN '' ELSE md5(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) END AS hash
  FROM (SELECT source AS project_id, {corpus.DOCUMENT_PATH} AS path, text FROM documents) WHERE NOT regexp_matches(path, {_PATH_IGNORED})""")
oracle("expand_archives", """SELECT 'd' || doc_id AS project_id, 'repo/doc_' || doc_id || '.txt' AS path, octet_length(encode(text)) AS size,
  'd' || doc_id || '.zip' AS archive, md5(text) AS hash FROM documents""")
oracle("normalize_project_root_scanner", """SELECT project_id, CASE WHEN length(project_id) % 2 = 0 THEN '' ELSE 'main/' END
  || CASE WHEN path <> 'requirements.txt' THEN path WHEN length(project_id) % 2 = 0 THEN 'Dockerfile' ELSE 'setup.cfg' END AS path, size FROM files""")
oracle("normalize_project_root", "SELECT project_id, path, size FROM files")
oracle("read_text_safely", """SELECT project_id, path, coalesce(length(content), -1) AS chars,
  '' AS error FROM files""")
oracle("results_json", f"SELECT project_id, count(*) AS commits, count(*) FILTER ({contains_any('lower(message)', rules.BUG_KEYWORDS)}) AS bug_count FROM commits GROUP BY ALL")
# --- scores
COMPONENTS = list(rules.MES_WEIGHTS)
oracle("mes_scores", f"""SELECT project_id, {', '.join(r6(c) for c in COMPONENTS)}, {r6('mes_raw')}, mes_level, CASE mes_level
  WHEN 'LOW' THEN 'LOW ENTANGLEMENT: Well-isolated architecture with minimal technical debt.'
  WHEN 'MODERATE' THEN 'MODERATE ENTANGLEMENT: Significant architectural debt. Phased isolation recommended.'
  ELSE 'CRITICAL ENTANGLEMENT: Severe model-service coupling. Immediate remediation required.' END AS mes_interpretation FROM mes""")
RISK = {
    "direct_calls": ("Direct model calls: ", " of threshold"), "shared_features": ("Shared features: ", " of services affected"),
    "pipeline_complexity": ("Complex pipelines: ", " are overly complex"), "retrain_frequency": ("Frequent retraining: ", " of threshold"),
    "impact_radius": ("Wide impact: changes affect ", " of services"), "feedback_loop": ("Feedback loops: ", " of services involved"),
}
CTES["risks"] = " UNION ALL ".join(
    f"SELECT project_id, {i} AS ord, '{c}' AS component, {c} AS value, '{RISK[c][0]}' || CAST(CAST(round_even({c} * 100, 0) AS BIGINT) AS VARCHAR) || '%{RISK[c][1]}' AS description FROM mes"
    for i, c in enumerate(COMPONENTS)
)
oracle("risk_factors", """SELECT project_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY value DESC, ord) AS INTEGER) AS rank, component,
  CASE WHEN value > 0.7::DOUBLE THEN 'HIGH' ELSE 'MEDIUM' END AS severity, round(value, 6) AS value, description FROM risks WHERE value > 0.4::DOUBLE""")
oracle("maintainability_scores", "SELECT project_id, maintainability_score, factors, 'stable' AS churn_trend, 'stable' AS bug_trend, 'stable' AS activity_trend FROM maint")
PCT1 = "printf('%.1f%%', round_even({} * 100, 1))"
CTES["smell_flags"] = """SELECT *, direct_ratio > 0.3::DOUBLE AS d, glue_ratio > 0.3::DOUBLE AS g, hidden_count > 3 AS h FROM m"""
CTES["smell_sums"] = """SELECT *, CAST(d AS BIGINT) + CAST(g AS BIGINT) + CAST(h AS BIGINT) AS critical_smells,
  CAST(NOT d AND direct_count > 0 AS BIGINT) + CAST(NOT g AND glue_ratio > 0.2::DOUBLE AS BIGINT) + CAST(NOT h AND hidden_count > 0 AS BIGINT)
  + complex_pipelines + CAST(retrain_count > 4 AS BIGINT) + CAST(loops_count > 0 AS BIGINT) AS warning_smells FROM smell_flags"""
oracle("smell_summary", f"""SELECT project_id, critical_smells, warning_smells, critical_smells + warning_smells AS total_smells,
  concat_ws('|', CASE WHEN d THEN 'direct_model_calls' END, CASE WHEN g THEN 'glue_code' END, CASE WHEN h THEN 'hidden_consumers' END,
    CASE WHEN retrain_count > 4 THEN 'retrain_frequency' END, CASE WHEN loops_count > 0 THEN 'feedback_loops' END) AS issue_types,
  concat_ws('|', CASE WHEN d THEN 'critical' END, CASE WHEN g THEN 'critical' END, CASE WHEN h THEN 'critical' END,
    CASE WHEN retrain_count > 4 THEN 'warning' END, CASE WHEN loops_count > 0 THEN 'warning' END) AS severities,
  concat_ws('|', CASE WHEN d THEN direct_count || ' services directly call ML models' END,
    CASE WHEN g THEN 'Glue code is ' || {PCT1.format('glue_ratio')} || ' of codebase' END,
    CASE WHEN h THEN hidden_count || ' hidden model consumers' END,
    CASE WHEN retrain_count > 4 THEN 'Models retrained ' || retrain_count || 'x/month' END,
    CASE WHEN loops_count > 0 THEN loops_count || ' potential feedback loops' END) AS messages FROM smell_sums""")
oracle("smell_radar", " UNION ALL ".join(
    f"SELECT project_id, '{axis}' AS axis, round(least(10.0::DOUBLE, CAST({v} AS DOUBLE)), 6) AS value FROM m"
    for axis, v in (("Direct Model Calls", "direct_ratio * 10"), ("Glue Code", "glue_ratio * 10"), ("Hidden Consumers", "hidden_count * 2"),
                    ("Pipeline Complexity", "complex_pipelines * 2"), ("Retrain Frequency", "retrain_count / 2"), ("Feedback Loops", "loops_count * 2"))
))
oracle("degradation_ratio", "SELECT project_id, avg_isolated_mes, avg_non_isolated_mes, degradation_ratio, hypothesis_confirmed FROM valid")
oracle("mes_correlations", """SELECT project_id, mes_churn, mes_bug, mes_impact, combined, 0.05::DOUBLE AS p_value_degradation, 0.03::DOUBLE AS p_value_correlations,
  0.95::DOUBLE AS confidence_level, services_count AS sample_size, true AS is_significant, accuracy_rate FROM valid""")
# twice the mean rank of each value, less the mean of all
_RANKS = ", ".join(
    f"2 * rank() OVER (ORDER BY {m}) + count(*) OVER (PARTITION BY {m}) - 1 - (count(*) OVER () + 1) AS {m}" for m in [significance.FIRST, *significance.OTHERS]
)
CTES["fleet"] = f"SELECT row_number() OVER (ORDER BY project_id) - 1 AS j, count(*) OVER () AS n, {_RANKS} FROM valid"
CTES["fleet_rho"] = " UNION ALL ".join(
    f"SELECT '{m}' AS measure, max(n) AS projects, corr({significance.FIRST}, {m}) AS rho, sum({significance.FIRST} * {m}) AS product FROM fleet" for m in significance.OTHERS
)
oracle("rank_correlations", "SELECT measure, projects, round(rho, 6) AS rho FROM fleet_rho")
_MAPS = values([(i, a, c) for i, (a, c) in enumerate(significance.shuffles(significance.PERMUTATIONS, significance.SEED))])
CTES["fleet_drawn"] = " UNION ALL ".join(
    f"""SELECT '{m}' AS measure, i, sum(x.{significance.FIRST} * y.{m}) AS drawn FROM fleet x, {_MAPS} maps(i, a, c), fleet y
    WHERE y.j = (CAST(a AS HUGEINT) * x.j + c) % x.n GROUP BY i""" for m in significance.OTHERS
)
oracle("permutation_p_values", f"""SELECT measure, projects, round(rho, 6) AS rho, (count(*) FILTER (WHERE abs(drawn) >= abs(product)) + 1) / {significance.PERMUTATIONS + 1}::DOUBLE AS p_value
  FROM fleet_rho JOIN fleet_drawn USING (measure) GROUP BY measure, projects, rho""")
ONE = "printf('%.1f', round_even({}, 1))"
oracle("validation_interpretation", f"""SELECT project_id, CASE WHEN hypothesis_confirmed THEN '✓ HYPOTHESIS CONFIRMED: Systems with proper AI isolation show ' || degradation_ratio
    || 'x slower degradation, exceeding the 3x threshold.' ELSE '⚠ HYPOTHESIS NOT FULLY CONFIRMED: The degradation ratio of ' || degradation_ratio
    || 'x is below the 3x threshold. This may be due to partial isolation or other mitigating factors.' END || chr(10) ||
  CASE WHEN combined > 0.7::DOUBLE THEN '📊 STRONG CORRELATION (r=' || combined || ') between MES and maintainability issues. Higher entanglement strongly predicts more bugs and churn.'
    WHEN combined > 0.5::DOUBLE THEN '📊 MODERATE CORRELATION (r=' || combined || ') between MES and maintainability issues. Model entanglement contributes to technical debt.'
    ELSE '📊 WEAK CORRELATION (r=' || combined || ') between MES and maintainability metrics. Other factors may be influencing maintainability.' END || chr(10) ||
  CASE WHEN avg_isolated_mes < avg_non_isolated_mes * 0.5::DOUBLE THEN '🛡️ STRONG ISOLATION EFFECT: Isolated systems have ' || {ONE.format('avg_isolated_mes')} || ' MES vs ' || {ONE.format('avg_non_isolated_mes')}
      || ' for non-isolated, a ' || {ONE.format('avg_non_isolated_mes / avg_isolated_mes')} || 'x difference.'
    WHEN avg_isolated_mes < avg_non_isolated_mes * 0.7::DOUBLE THEN '🛡️ MODERATE ISOLATION EFFECT: Isolated systems show ' || {ONE.format('avg_isolated_mes')} || ' MES vs ' || {ONE.format('avg_non_isolated_mes')} || ' for non-isolated.'
    ELSE '🛡️ WEAK ISOLATION EFFECT: Isolated systems (' || {ONE.format('avg_isolated_mes')} || ' MES) show minimal difference from non-isolated (' || {ONE.format('avg_non_isolated_mes')} || ').' END AS interpretation FROM valid""")
PAIRS = {(0, 1): "mes_churn", (0, 2): "mes_bug", (0, 3): "mes_impact", (1, 2): "0.6::DOUBLE", (1, 3): "0.5::DOUBLE", (2, 3): "0.7::DOUBLE"}
LABELS = ["MES", "Churn", "Bugs", "Impact"]
oracle("correlation_matrix", " UNION ALL ".join(
    f"SELECT project_id, '{LABELS[i]}' AS \"row\", '{LABELS[j]}' AS \"column\", {'1.0::DOUBLE' if i == j else PAIRS[min(i, j), max(i, j)]} AS value FROM valid"
    for i in range(4) for j in range(4)
))
oracle("project_profiles", """SELECT project_id, concat_ws('|', CASE WHEN services_count > 1 THEN 'Microservices architecture detected' END,
    CASE WHEN models_count > 0 THEN 'AI components integrated' END) AS patterns,
  CASE WHEN services_count > 1 THEN 'Microservices' ELSE 'Monolith' END AS architectural_style,
  CASE WHEN models_count > 0 THEN 'Emerging' ELSE 'None' END AS ai_maturity,
  CASE WHEN services_count > 1 THEN 'Service-based architecture' ELSE 'Monolithic' END AS pattern, 'hybrid' AS communication_style,
  CASE WHEN services_count = 1 THEN 'Potential single point of failure' ELSE 'None detected' END AS bottleneck,
  CASE WHEN direct_count > 0 THEN 'direct_model_coupling' ELSE '' END AS issue_type,
  CASE WHEN direct_count > 0 THEN 'Model changes will require widespread service updates' ELSE 'Low impact expected' END AS impact_prediction FROM m""")
oracle("debt_forecast", """SELECT project_id, predicted_increase, round(least(10.0::DOUBLE, mes_score + predicted_increase), 6) AS six_month_forecast,
  round(least(10.0::DOUBLE, mes_score + predicted_increase * 2), 6) AS twelve_month_forecast,
  CASE WHEN mes_score > 7 THEN 'ASAP' WHEN mes_score > 4 THEN 'Within 3 months' ELSE 'Within 6 months' END AS intervention_timeline
  FROM (SELECT *, CASE WHEN mes_score > 7 THEN 2.5::DOUBLE WHEN mes_score > 4 THEN 1.5::DOUBLE ELSE 0.5::DOUBLE END AS predicted_increase FROM mes)""".replace("FROM mes)", "FROM mes )"))
oracle("risk_assessment", f"""SELECT project_id, CASE WHEN bug_rate > 0.3::DOUBLE OR mes_score > 7 THEN 'High' WHEN bug_rate > 0.15::DOUBLE OR mes_score > 4 THEN 'Medium' ELSE 'Low' END AS overall_risk,
  CASE WHEN bug_rate > 0.3::DOUBLE OR mes_score > 7 THEN 0.8::DOUBLE WHEN bug_rate > 0.15::DOUBLE OR mes_score > 4 THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END AS criticality_score,
  CASE WHEN bug_rate > 0.2::DOUBLE THEN 'High bug rate (' || {PCT1.format('bug_rate')} || ')' ELSE 'Low bug rate' END AS bug_factor,
  CASE WHEN bug_rate > 0.2::DOUBLE THEN 'High' ELSE 'Low' END AS bug_severity,
  CASE WHEN mes_score > 7 THEN 'Critical' WHEN mes_score > 4 THEN 'Medium' ELSE 'Low' END AS mes_severity FROM mes""")
oracle("architecture_proposal", """SELECT project_id, CASE WHEN mes_score > 7 THEN 'Full Isolation Architecture' WHEN mes_score > 4 THEN 'Gradual Decoupling Architecture'
    ELSE 'Well-Integrated Architecture' END AS architecture_name,
  concat_ws('|', 'API Gateway', CASE WHEN models_count > 0 THEN 'Model Serving Layer' END, CASE WHEN glue_ratio > 0.2::DOUBLE THEN 'Feature Store' END, 'Observability Stack') AS components,
  CAST(1 + CAST(models_count > 0 AS INTEGER) AS BIGINT) AS flows,
  concat_ws('|', CASE WHEN direct_count > 0 THEN 'Introduce model serving layer to eliminate direct model calls' ELSE 'Decouple AI models from business logic' END,
    CASE WHEN glue_ratio > 0.2::DOUBLE THEN 'Implement shared feature engineering library' END,
    CASE WHEN direct_count > 0 THEN 'Decouple AI models from business logic' END, 'Implement model versioning and canary deployments',
    'Add comprehensive monitoring and observability', 'Standardize data transformation pipelines') AS improvements,
  CASE WHEN mes_score > 7 THEN 'High' WHEN mes_score > 4 THEN 'Medium' ELSE 'Low' END AS estimated_effort,
  CASE WHEN mes_score > 0 THEN round_even(least(5.0::DOUBLE, mes_score * 0.6::DOUBLE), 1) ELSE 3.0::DOUBLE END AS expected_mes_reduction FROM mes""")
oracle("proposed_services", """SELECT project_id, string_agg(name, '|' ORDER BY rn) AS names, string_agg(language, '|' ORDER BY rn) AS languages FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY name, path) AS rn FROM svc) WHERE rn <= 5 GROUP BY project_id""")
CTES["first_svc"] = """SELECT project_id, string_agg(name, '|' ORDER BY rn) AS names, string_agg(language, '|' ORDER BY rn) AS languages FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY name, path) AS rn FROM svc) WHERE rn <= 5 GROUP BY project_id"""
oracle("proposed_architecture", """SELECT project_id, CASE WHEN mes_score > 7 THEN 'Full Isolation Architecture' WHEN mes_score > 4 THEN 'Gradual Decoupling Architecture'
    ELSE 'Well-Integrated Architecture' END AS architecture_name,
  concat_ws('|', 'API Gateway', names, CASE WHEN models_count > 0 THEN 'Model Serving Layer' END, CASE WHEN glue_ratio > 0.2::DOUBLE THEN 'Feature Store' END, 'Observability Stack') AS components,
  concat_ws('|', 'Kong|NGINX|Traefik', languages, CASE WHEN models_count > 0 THEN 'BentoML|Seldon Core|KServe' END,
    CASE WHEN glue_ratio > 0.2::DOUBLE THEN 'Feast|Tecton|Hopsworks' END, 'Prometheus|Grafana|Jaeger') AS technologies
  FROM project_mes LEFT JOIN first_svc USING (project_id)""")
INSIGHTS = [
    ("direct_count > 0", "'Architectural Smell: Direct Model Coupling'", "'Detection of ' || direct_count || ' services with direct model dependencies'",
     "'High - Each model change requires coordinated updates across multiple services'", "'Implement dedicated model serving layer with versioned APIs'"),
    ("hidden_count > 0", "'Architectural Smell: Hidden Model Consumers'", "'Identification of ' || hidden_count || ' undocumented model consumers'",
     "'Critical - Breaking changes may affect unknown downstream systems'", "'Establish model registry and consumer documentation portal'"),
    ("glue_ratio > 0.15::DOUBLE", "'Architectural Smell: Excessive Glue Code'", f"'Glue code constitutes ' || {PCT1.format('glue_ratio')} || ' of codebase'",
     "'Medium - Increased maintenance cost and reduced developer productivity'", "'Standardize data transformation pipelines with reusable components'"),
    ("loops_count > 0", "'Architectural Smell: Feedback Loops'", "'Detection of ' || loops_count || ' potential feedback loops between prediction and training'",
     "'Critical - May cause model degradation and system instability'", "'Implement shadow deployment and A/B testing for model validation'"),
    ("NOT (direct_count > 0 OR hidden_count > 0 OR glue_ratio > 0.15::DOUBLE OR loops_count > 0)", "'Architectural Assessment'",
     "'Well-structured AI integration with minimal technical debt'", "'Low - System maintainability is within acceptable parameters'",
     "'Continue monitoring and apply preventative patterns'"),
]
oracle("insight_rows", " UNION ALL ".join(
    f"SELECT project_id, {t} AS title, {f} AS finding, {i} AS impact, {a} AS recommendation FROM m WHERE {c}" for c, t, f, i, a in INSIGHTS
))
TWO = "printf('%.2f', round_even({}, 2))"
SUMMARY = [
    ("findings", "Model Entanglement Score", TWO.format("mes_score") + " || '/10 - ' || mes_level"),
    ("findings", "Bug Rate Impact", PCT1.format("bug_rate") + " || ' of commits are bug fixes'"),
    ("tier1", "Total Services Detected", "CAST(services_count AS VARCHAR)"), ("tier1", "Total ML Models Flagged", "CAST(models_count AS VARCHAR)"),
    ("tier1", "Code Files Scanned", "CAST(services_count * 3 AS VARCHAR)"), ("tier2", "API Endpoints", "CAST(pipelines_count AS VARCHAR)"),
    ("tier2", "External Dependencies", "CAST(services_count AS VARCHAR)"),
    ("tier2", "Architecture Style", "CASE WHEN services_count > 1 THEN 'Microservices' ELSE 'Monolith' END"),
    ("tier3", "Direct Model Calls", "direct_count || ' instances'"), ("tier3", "Glue Code Ratio", PCT1.format("glue_ratio")),
    ("tier3", "Hidden Consumers", "hidden_count || ' detected'"),
    *[("tier4", c.replace("_", " ").title(), TWO.format(c)) for c in COMPONENTS],
    ("tier5", "Commits", "CAST(commit_count AS VARCHAR)"), ("tier5", "Bug-Fix Ratio", PCT1.format("bug_rate")),
    ("tier5", "Change Impact Radius", TWO.format("avg_change_impact")),
    ("tier6", "Analysis Accuracy", ONE.format("accuracy_rate") + " || '%'"),
    ("tier6", "Degradation Ratio", "CASE WHEN isinf(degradation_ratio) THEN 'inf' ELSE " + TWO.format("degradation_ratio") + " END || 'x'"),
    ("tier6", "Hypothesis Confirmed", "CASE WHEN hypothesis_confirmed THEN 'Yes' ELSE 'No' END"),
    ("outlook", "Target MES", TWO.format("greatest(0.0::DOUBLE, mes_score - 4)")),
    ("outlook", "Confidence Band", "CASE WHEN accuracy_rate >= 90 THEN 'HIGH CONFIDENCE' WHEN accuracy_rate >= 70 THEN 'RELIABLE ANALYSIS' ELSE 'LOW CONFIDENCE' END"),
]
oracle("summary_tables", " UNION ALL ".join(f"SELECT project_id, '{s}' AS section, '{m}' AS metric, {v} AS value FROM valid" for s, m, v in SUMMARY))
# --- tiers
CTES["profile"] = """SELECT s.project_id, s.name, s.path, (SELECT count(*) FROM eps e WHERE e.project_id = s.project_id AND e.service_path = s.path) AS endpoint_count,
  EXISTS (SELECT 1 FROM calls c WHERE c.project_id = s.project_id AND c.service = s.name) AS is_direct,
  EXISTS (SELECT 1 FROM loops l WHERE l.project_id = s.project_id AND l.service = s.name) AS in_loop,
  (SELECT arg_max(g.glue_lines / g.total_lines, g.path) FROM glue g WHERE g.project_id = s.project_id AND g.service = s.name) AS glue_ratio,
  coalesce((SELECT avg(impact_radius) FROM impact i WHERE i.project_id = s.project_id), 0) AS avg_impact FROM svc s"""
CTES["iso"] = """SELECT *, CASE WHEN is_direct THEN 0 ELSE 3 END + 2 + CASE WHEN endpoint_count > 0 THEN 1 ELSE 0 END + CASE WHEN in_loop THEN 0 ELSE 2 END
    + CASE WHEN coalesce(glue_ratio, 1) < 0.2::DOUBLE THEN 2 ELSE 0 END AS isolation_score,
  CASE WHEN is_direct THEN 3 ELSE 0 END + CASE WHEN coalesce(glue_ratio, 0) > 0.3::DOUBLE THEN 3 WHEN coalesce(glue_ratio, 0) > 0.2::DOUBLE THEN 2 ELSE 0 END
    + CASE WHEN in_loop THEN 2 ELSE 0 END + CASE WHEN avg_impact > 3 THEN 2 ELSE 0 END AS violation_score FROM profile"""
oracle("service_isolation", """SELECT project_id, name, path, endpoint_count, is_direct, in_loop, isolation_score, violation_score,
  isolation_score >= 5 AS is_isolated, violation_score >= 4 AS is_non_isolated FROM iso""")
oracle("mes_report", f"""SELECT project_id, services_count, models_count, pipelines_count, direct_count, hidden_count, complex_pipelines, retrain_count, loops_count,
  shared_count, {r6('glue_ratio')}, {r6('avg_impact')}, {r6('mes_raw')}, mes_level FROM project_mes""")
oracle("maintainability_report", f"""SELECT project_id, commit_count, bug_count, {r6('bug_rate')}, top5_changes, top20_changes, {r6('avg_change_impact')},
  max_change_impact, maintainability_score, factors FROM project_maint""")
CTES["full_rows"] = """SELECT p.*, k.commit_count, k.bug_rate, k.avg_change_impact, k.maintainability_score, i.isolated_mean, i.non_isolated_mean
  FROM project_mes p JOIN project_maint k USING (project_id) LEFT JOIN (SELECT project_id,
    avg(greatest(1, 10 - isolation_score)) FILTER (isolation_score >= 5) AS isolated_mean,
    avg(least(10.0::DOUBLE, violation_score * 1.5::DOUBLE)) FILTER (violation_score >= 4) AS non_isolated_mean FROM iso GROUP BY ALL) i USING (project_id)"""
CTES["full_valid"] = CTES["valid"].replace("FROM mes", "FROM full_rows")
CTES["best1"] = BEST.format("types1")
CTES["plang"] = ORACLES["primary_language"].split("\nSELECT p.project_id")[1].join(["SELECT p.project_id", ""])
oracle("full_analysis", """SELECT v.project_id, l.language, b.project_type, f.n AS files_count, v.services_count, v.models_count,
  (SELECT count(*) FROM eps e WHERE e.project_id = v.project_id) AS endpoint_count, (SELECT count(*) FROM deps d WHERE d.project_id = v.project_id) AS dependency_edges,
  v.mes_score, v.mes_level, v.maintainability_score, v.degradation_ratio, v.accuracy_rate,
  (SELECT string_agg(framework, '|' ORDER BY framework) FROM mani x WHERE x.project_id = v.project_id) AS frameworks
  FROM full_valid v JOIN plang l ON l.project_id = v.project_id JOIN best1 b ON b.project_id = v.project_id
  JOIN (SELECT project_id, count(*) AS n FROM tree WHERE NOT ignored GROUP BY ALL) f ON f.project_id = v.project_id""")
CTES["share"] = TOP_SHARE
oracle("language_report", """SELECT s.project_id, s.language, s.files, s.total_files, s.percentage, b.project_type,
  (SELECT string_agg(build_system, '|' ORDER BY build_system) FROM builds x WHERE x.project_id = s.project_id) AS build_systems
  FROM share s JOIN best2 b ON b.project_id = s.project_id""")
oracle("git_report", f"""SELECT i.project_id, i.commit_count, i.contributors_count, r.commits, r.bug_count, round(r.bug_count / r.commits, 6) AS bug_rate FROM info i LEFT JOIN (
  SELECT project_id, count(*) AS commits, count(*) FILTER ({contains_any('lower(message)', rules.BUG_KEYWORDS)}) AS bug_count FROM commits
  WHERE committed_at >= TIMESTAMP '2001-08-01' - INTERVAL 180 DAY GROUP BY ALL) r ON r.project_id = i.project_id""")

assert set(ORACLES) <= set(queries.QUERIES)
