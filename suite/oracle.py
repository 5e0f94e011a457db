"""The same queries in plain SQL, written independently of the Spark code."""

from __future__ import annotations

from suite import views as v

TABLES = {name: name for name in ("documents", "pages", "labels", "conversations", "part", "benchmark")}

# Which characters are tokens, and what counts as a link in either mode.
SPACE = r"\x09-\x0d\x1c-\x20\x85\p{Z}"
SINGLES = r"""@#$%&*\[\]{}<>"`«»“”‘’„"""
PUNCTUATION = r""".?!,;:\-\\()_''"""
TOKEN = f"[{SINGLES}]|[^{SPACE}{PUNCTUATION}{SINGLES}]+"
STRICT = (
    r"(?:(?:https?|ftp)://)?(?:[\p{L}\p{N}_-]+\.)*([\p{L}\p{N}_-]+)\."
    rf"(?:de|com|net|org|nl|ca|co\.uk|co|ly|le|in|es)\b(?:[/?#][^{SPACE}]*)?"
)
COMPAT = (
    r"[http:\/\/|ftp:\/\/|https:\/\/]*[www\.]*([\p{L}\p{N}_-]+)\.[de|com|net|org|nl|ca|co\.uk|co|ly|le|in|es]"
    r"[\p{L}\p{N}_?=%&/#]*[\p{L}\p{N}_@?^=%&\/~+#-]"
)
TRIMMED = r"[\x09-\x0d\x1c-\x20\x85\p{Z}]"


def literals(values) -> str:
    return ", ".join("'" + value.replace("'", "''") + "'" for value in values)


def normalized(raw: str, link: str = STRICT) -> str:
    return f"""
SELECT '' AS query, subreddit, id AS post_id, permalink AS link,
  strftime(make_timestamp(CAST(floor(created_utc) AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') AS date,
  author, title, replace(selftext, ';', ':') AS body, num_comments AS n_comments, upvote_ratio AS up_ratio,
  distinguished, over_18 AS is_nsfw,
  list_concat(coalesce(regexp_extract_all(title, '{link}'), []),
    coalesce(regexp_extract_all(replace(selftext, ';', ':'), '{link}'), [])) AS external_links,
  list_concat(coalesce(regexp_extract_all(title, '{link}', 1), []),
    coalesce(regexp_extract_all(replace(selftext, ';', ':'), '{link}', 1), [])) AS link_domains,
  created_utc, score
FROM {raw}"""


def strip(text: str) -> str:
    return rf"regexp_replace({text}, '^{TRIMMED}+|{TRIMMED}+\z', '', 'g')"


def line(title: str, body: str, missing: str) -> str:
    spaced = f"concat(coalesce({title}, '{missing}'), ' ', coalesce({body}, '{missing}'))"
    return strip(f"regexp_replace(replace(replace({spaced}, '<newline>', ' '), chr(9), ' '), ' +', ' ', 'g')")


LEMMA_CASES = " ".join(f"WHEN '{form}' THEN '{lemma}'" for form, lemma in v.LEMMAS.items())


def cleaned(text: str, stop: str) -> str:
    return f"""list_transform(
    list_filter(regexp_extract_all(lower({text}), '{TOKEN}'), lambda t: NOT list_contains({stop}, t)),
    lambda t: CASE t {LEMMA_CASES} ELSE t END)"""


KEYWORD_ROWS = ", ".join(f"({i}, '{k}')" for i, k in enumerate(v.KEYWORDS))
SCOPE_ROWS = ", ".join(f"('{s}')" for s in v.SCOPES)

CTES = {
    "raw_posts": v.RAW_POSTS.format(**TABLES),
    "raw_copies": v.RAW_COPIES.format(**TABLES),
    "raw_pages": v.RAW_PAGES.format(**TABLES),
    "raw_comments": v.RAW_COMMENTS.format(**TABLES),
    "descr": v.DESCRIPTION.format(**TABLES),
    "phrases": v.PHRASES,
    "posts": normalized("raw_posts"),
    "compat_posts": normalized("raw_posts", COMPAT),
    "copies": normalized("raw_copies"),
    "page_posts": normalized("raw_pages"),
    "compat_pages": normalized("raw_pages", COMPAT),
    "comments": """
SELECT post_id, id AS comment_id, author, body FROM raw_comments
WHERE parent_is_post AND (body IS NULL OR body <> '[deleted]')""",
    "keywords": f"SELECT * FROM (VALUES {KEYWORD_ROWS}) AS k(pos, term)",
    "scopes": f"SELECT * FROM (VALUES {SCOPE_ROWS}) AS s(scope)",
    "authors": f"SELECT * FROM (VALUES {', '.join(f'({chr(39)}{a}{chr(39)})' for a in v.AUTHORS)}) AS a(author)",
    "counts": "SELECT subreddit, CAST(count(*) AS BIGINT) AS n_posts FROM posts WHERE subreddit IS NOT NULL GROUP BY subreddit",
    "described": """
SELECT d.subreddit, coalesce(c.n_posts, 0) AS n_posts, CAST(0 AS BIGINT) AS n_comments
FROM descr d LEFT JOIN counts c ON c.subreddit = d.subreddit""",
    "lines": f"SELECT subreddit, post_id, {line('title', 'body', '')} AS line FROM posts",
    "tokens": f"SELECT subreddit, post_id, {cleaned('line', f'[{literals(v.STOPWORDS)}]')} AS toks FROM lines",
    "clean": """
SELECT subreddit, post_id, CASE WHEN len(toks) > 2 THEN array_to_string(toks, ' ') ELSE '' END AS clean FROM tokens""",
    "mention_counts": """
SELECT subreddit, mention, CAST(count(*) AS BIGINT) AS cnt
FROM (SELECT subreddit, unnest(toks) AS mention FROM tokens)
WHERE starts_with(mention, 'r/')
  AND subreddit IN (SELECT subreddit FROM tokens GROUP BY subreddit HAVING sum(len(toks)) > 2)
GROUP BY subreddit, mention""",
    "words": r"SELECT subreddit, post_id, regexp_extract_all(lower(clean), '[\p{L}\p{N}_]{2,}') AS w FROM clean",
    "word_rows": """
SELECT subreddit, word AS w1, lead(word, 1) OVER ahead AS w2, lead(word, 2) OVER ahead AS w3, lead(word, 3) OVER ahead AS w4,
  lead(word, 4) OVER ahead AS w5
FROM (SELECT subreddit, post_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM words)
WINDOW ahead AS (PARTITION BY post_id ORDER BY pos)""",
    "ngram_counts": """
SELECT subreddit, ngram, CAST(count(*) AS BIGINT) AS cnt
FROM (SELECT subreddit, concat(w1, ' ', w2, ' ', w3) AS ngram FROM word_rows WHERE w3 IS NOT NULL
  UNION ALL SELECT subreddit, concat(w1, ' ', w2, ' ', w3, ' ', w4) FROM word_rows WHERE w4 IS NOT NULL
  UNION ALL SELECT subreddit, concat(w1, ' ', w2, ' ', w3, ' ', w4, ' ', w5) FROM word_rows WHERE w5 IS NOT NULL)
WHERE subreddit IN (SELECT subreddit FROM counts WHERE n_posts > 2)
GROUP BY subreddit, ngram HAVING count(*) >= 7""",
    "domain_totals": """
SELECT subreddit, domain, CAST(count(*) AS BIGINT) AS cnt
FROM (SELECT subreddit, unnest(link_domains) AS domain FROM posts) GROUP BY subreddit, domain""",
    "comment_counts": """
SELECT p.subreddit, CAST(count(*) AS BIGINT) AS n_comments
FROM comments c JOIN posts p ON p.post_id = c.post_id GROUP BY p.subreddit""",
    "matched": """
SELECT s.scope, concat('"', k.term, '"') AS query, p.post_id, p.subreddit, p.date, p.created_utc, p.score, p.link_domains
FROM posts p JOIN scopes s ON s.scope = 'all' OR s.scope = p.subreddit
JOIN keywords k ON contains(lower(concat_ws(' ', p.title, p.body)), lower(k.term))""",
    "newest": """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scope, query ORDER BY created_utc DESC, post_id) AS rn FROM matched)""",
    "by_author": """
SELECT *, row_number() OVER (PARTITION BY author ORDER BY created_utc DESC, post_id) AS rn FROM posts
WHERE author IS NOT NULL""",
    "features": """
SELECT d.subreddit, 'n_posts' AS feature, '' AS item, d.n_posts AS cnt FROM described d
UNION ALL SELECT d.subreddit, 'n_comments', '', coalesce(c.n_comments, 0) FROM descr d LEFT JOIN comment_counts c USING (subreddit)
UNION ALL SELECT subreddit, 'mention', mention, cnt FROM mention_counts WHERE subreddit IN (SELECT subreddit FROM descr)
UNION ALL SELECT subreddit, 'ngram', ngram, cnt FROM ngram_counts WHERE subreddit IN (SELECT subreddit FROM descr)
UNION ALL SELECT subreddit, 'domain', domain, cnt FROM domain_totals WHERE subreddit IN (SELECT subreddit FROM descr)""",
}


def windows_sql(terms: str, term: str) -> str:
    """Contexts of literal hits: last six words before, first six after, of the pieces between hits."""
    return rf"""
SELECT post_id, term, CAST(i AS BIGINT) AS hit,
  concat(array_to_string(list_filter(regexp_split_to_array(seg[i], '{TRIMMED}+'), lambda x: x <> '')[-6:], ' '), ' ', term, ' ',
    array_to_string(list_filter(regexp_split_to_array(seg[i + 1], '{TRIMMED}+'), lambda x: x <> '')[:6], ' ')) AS "window"
FROM (SELECT post_id, term, seg, unnest(range(1, len(seg))) AS i
  FROM (SELECT p.post_id, {term} AS term, string_split(lower(p.body), {term}) AS seg
    FROM posts p, {terms} k WHERE contains(lower(p.body), {term})))"""


def query(select: str, *extra: tuple[str, str]) -> str:
    parts = [f"{name} AS ({text})" for name, text in [*CTES.items(), *extra]]
    return "WITH " + ",\n".join(parts) + "\n" + select


BENCH_WORDS = ("bench_words", f"SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS word FROM benchmark")
COPY_TEXTS = ("copy_texts", f"""
SELECT post_id, author, date, created_utc, array_to_string(regexp_extract_all(lower({line('title', 'body', '')}), '{TOKEN}'), ' ') AS txt,
  len(regexp_extract_all(lower({line('title', 'body', '')}), '{TOKEN}')) AS n_tokens FROM copies""")
REPEATED = ("repeated", """
SELECT author, post_id FROM (SELECT *, count(*) OVER (PARTITION BY author, txt) AS n FROM copy_texts WHERE n_tokens > 2) WHERE n >= 2""")
WINDOWS = ("found", windows_sql("keywords", "lower(k.term)"))

ORACLE: dict[str, str] = {
    "subreddit_counts": query("SELECT * FROM counts"),
    "description_left_join": query("SELECT * FROM described"),
    "description_total": query("""
SELECT * FROM described UNION ALL
SELECT 'all', CAST(coalesce(sum(n_posts), 0) AS BIGINT), CAST(0 AS BIGINT) FROM described
HAVING NOT coalesce(bool_or(subreddit = 'all'), false)"""),
    "normalize_posts": query("""
SELECT query, subreddit, post_id, link, date, author, title, body, n_comments, up_ratio, distinguished, is_nsfw,
  array_to_string(external_links, ' ') AS external_links FROM posts"""),
    "post_links": query("""
SELECT post_id, CAST(i - 1 AS BIGINT) AS at, external_links[i] AS link, link_domains[i] AS domain
FROM (SELECT *, unnest(range(1, len(external_links) + 1)) AS i FROM page_posts)"""),
    "post_links_compat": query("""
SELECT post_id, CAST(i - 1 AS BIGINT) AS at, external_links[i] AS link, link_domains[i] AS domain
FROM (SELECT *, unnest(range(1, len(external_links) + 1)) AS i FROM compat_pages)"""),
    "domain_counts_by_post": query("""
SELECT post_id, domain, CAST(count(*) AS BIGINT) AS cnt
FROM (SELECT post_id, unnest(link_domains) AS domain FROM page_posts) GROUP BY post_id, domain"""),
    "domain_counts": query("SELECT * FROM domain_totals"),
    "domain_counts_compat": query("""
SELECT subreddit, domain, CAST(count(*) AS BIGINT) AS cnt
FROM (SELECT subreddit, unnest(link_domains) AS domain FROM compat_posts) GROUP BY subreddit, domain"""),
    "corpus_lines": query("SELECT * FROM lines"),
    "corpus_lines_compat": query(
        f"SELECT subreddit, post_id, {line('title', 'body', 'nan')} AS line FROM posts WHERE subreddit = 'src7'"
    ),
    "corpus_by_subreddit": query("""
SELECT subreddit, part, string_agg(line, ' ' ORDER BY post_id) AS text
FROM (SELECT *, CAST((sum(length(line)) OVER (PARTITION BY subreddit ORDER BY post_id ROWS UNBOUNDED PRECEDING) - length(line))
    // 40000 AS BIGINT) AS part FROM lines WHERE line <> '')
GROUP BY subreddit, part"""),
    "clean_text": query("SELECT post_id, clean FROM clean"),
    "clean_tokens_with_tables": query(
        "SELECT post_id, array_to_string(" + cleaned("line", "stop") + ", ' ') AS tokens"
        " FROM lines, (SELECT list(word) AS stop FROM bench_words)",
        BENCH_WORDS,
    ),
    "mentions": query("SELECT * FROM mention_counts"),
    "raw_mentions": query(f"""
SELECT subreddit, mention, CAST(count(*) AS BIGINT) AS cnt
FROM (SELECT subreddit, unnest(regexp_split_to_array(line, '{TRIMMED}+')) AS mention FROM lines)
WHERE starts_with(mention, 'r/') GROUP BY subreddit, mention"""),
    "frequent_ngrams": query("SELECT * FROM ngram_counts"),
    "keyword_windows": query(windows_sql("keywords", "lower(k.term)")),
    "keyword_windows_compat": query(windows_sql("keywords", "k.term")),
    "keyword_windows_with_table": query(windows_sql("(SELECT DISTINCT query, term FROM phrases)", "lower(k.term)")),
    "add_windows": query("""
SELECT p.post_id, CASE WHEN length(p.body) > 0 THEN coalesce(w.all_windows, '') END AS "window"
FROM posts p LEFT JOIN (SELECT f.post_id, string_agg(f."window", chr(10) ORDER BY k.pos, f.hit) AS all_windows
  FROM found f JOIN keywords k ON lower(k.term) = f.term GROUP BY f.post_id) w USING (post_id)""", WINDOWS),
    "keyword_bundles": """
SELECT CAST(p_partkey // 25 AS BIGINT) AS query_no, string_agg(concat('"', p_name, '"'), ' OR ' ORDER BY p_partkey) AS query,
  CAST(count(*) AS BIGINT) AS n_terms FROM part GROUP BY p_partkey // 25
UNION ALL SELECT CAST(p_partkey AS BIGINT), concat('"', p_name, '"'), CAST(1 AS BIGINT) FROM part""",
    "match_keywords": query("SELECT scope, query, post_id, subreddit FROM matched"),
    "match_bundle": query("""
SELECT 'all' AS scope, (SELECT string_agg(concat('"', term, '"'), ' OR ' ORDER BY pos) FROM keywords) AS query, post_id
FROM posts p WHERE EXISTS (SELECT 1 FROM keywords k WHERE contains(lower(concat_ws(' ', p.title, p.body)), lower(k.term)))"""),
    "match_everything": query(
        "SELECT subreddit AS scope, '' AS query, post_id FROM posts WHERE subreddit IS NOT NULL"
        " UNION ALL SELECT 'all' AS scope, '' AS query, post_id FROM posts"
    ),
    "match_phrase_table": query("""
SELECT DISTINCT k.query, p.post_id FROM posts p
JOIN phrases k ON contains(lower(concat_ws(' ', p.title, p.body)), lower(k.term))"""),
    "rows_per_scope": query("""
SELECT s.scope, CAST(count(m.post_id) AS BIGINT) AS n_posts FROM scopes s LEFT JOIN matched m ON m.scope = s.scope GROUP BY s.scope"""),
    "newest_per_query": query("SELECT scope, query, post_id, date FROM newest WHERE rn <= 20"),
    "top_per_query": query("""
SELECT scope, query, post_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY scope, query ORDER BY score DESC, post_id) AS rk FROM matched) WHERE rk <= 20"""),
    "top_of_year": query("""
SELECT post_id, date, score FROM posts WHERE date BETWEEN '2024-01-20 00:00:00' AND '2025-01-20 00:00:00'"""),
    "comments_of_posts": query("""
SELECT DISTINCT c.* FROM comments c WHERE post_id IN (SELECT post_id FROM posts)"""),
    "comments_per_subreddit": query("SELECT * FROM comment_counts"),
    "posts_of_authors": query("""
SELECT author, post_id, date FROM by_author WHERE rn <= 10 AND author IN (SELECT author FROM authors)"""),
    "posts_of_flagged_authors": query("""
SELECT author, post_id, date FROM by_author WHERE author IN (SELECT author FROM posts WHERE is_nsfw)"""),
    "rows_per_author": query("""
SELECT a.author AS subreddit, CAST(count(b.post_id) AS BIGINT) AS n_posts, CAST(0 AS BIGINT) AS n_comments
FROM authors a LEFT JOIN by_author b ON b.author = a.author AND b.rn <= 10 GROUP BY a.author"""),
    "domains_per_author": query("""
SELECT author AS subreddit, domain, CAST(count(*) AS BIGINT) AS cnt
FROM (SELECT author, unnest(link_domains) AS domain FROM by_author WHERE rn <= 10 AND author IN (SELECT author FROM authors))
GROUP BY author, domain"""),
    "append_rows": query("""
SELECT query, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT post_id) AS BIGINT) AS n_posts
FROM (SELECT query, post_id FROM matched WHERE scope = 'all'
  UNION ALL SELECT '', post_id FROM by_author WHERE author IN (SELECT author FROM authors)) GROUP BY query"""),
    "remove_duplicates": query("SELECT post_id, min(query) AS query, min(date) AS date FROM matched GROUP BY post_id"),
    "remove_copies": query("""
SELECT post_id, date FROM (SELECT *, row_number() OVER (PARTITION BY txt ORDER BY created_utc, post_id) AS rn FROM copy_texts)
WHERE rn = 1""", COPY_TEXTS),
    "repeat_posts": query("SELECT * FROM repeated", COPY_TEXTS, REPEATED),
    "repeat_authors": query(
        "SELECT author, CAST(count(*) AS BIGINT) AS n_repeated FROM repeated GROUP BY author", COPY_TEXTS, REPEATED
    ),
    "column_widths": query(" UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST(coalesce(max(length(CAST({c} AS VARCHAR))), 0) AS BIGINT) AS width FROM posts"
        for c in (
            "query", "subreddit", "post_id", "link", "date", "author", "title", "body", "n_comments", "up_ratio", "distinguished",
            "is_nsfw", "score",
        )
    )),
    "preview": query("""
SELECT subreddit, title, body AS content, score AS upvotes, up_ratio AS upvote_ratio, n_comments
FROM posts ORDER BY score DESC, post_id LIMIT 5"""),
    "dataset_size": query("SELECT CAST(count(*) AS BIGINT) AS n_rows FROM posts"),
    "collect_search": query("SELECT scope, query, post_id FROM newest WHERE rn <= 50"),
    "collect_search_description": query("""
SELECT s.scope AS subreddit, CAST(count(m.post_id) AS BIGINT) AS n_posts, CAST(0 AS BIGINT) AS n_comments
FROM scopes s LEFT JOIN newest m ON m.scope = s.scope AND m.rn <= 50 GROUP BY s.scope"""),
    "collect_search_domains": query("""
SELECT scope AS subreddit, domain, CAST(count(*) AS BIGINT) AS cnt
FROM (SELECT scope, unnest(link_domains) AS domain FROM newest WHERE rn <= 50) GROUP BY scope, domain"""),
    "collect_top": query("""
SELECT s.scope, post_id, score FROM posts p JOIN (SELECT source AS scope FROM documents UNION SELECT 'all') s
  ON s.scope = 'all' OR s.scope = p.subreddit
WHERE date BETWEEN '2024-01-20 00:00:00' AND '2025-01-20 00:00:00'"""),
    "collect_new": query("""
SELECT scope, post_id FROM (SELECT s.scope, p.post_id,
    row_number() OVER (PARTITION BY s.scope ORDER BY p.created_utc DESC, p.post_id) AS rn
  FROM posts p JOIN scopes s ON s.scope = 'all' OR s.scope = p.subreddit) WHERE rn <= 15"""),
    "enriched_description": query("SELECT * FROM features"),
    "description_map_entries": query("""
SELECT subreddit, CASE feature WHEN 'domain' THEN 'external_links' WHEN 'mention' THEN 'sub_mentions' ELSE 'ngrams' END AS feature,
  item, cnt FROM features WHERE feature IN ('domain', 'mention', 'ngram')"""),
    "folded_domains": query("""
SELECT post_id, CAST(CAST(concat('0x', substr(md5(domain), 1, 8)) AS BIGINT) % ((n + 1) // 2) AS BIGINT) AS part, domain, cnt
FROM (SELECT *, count(*) OVER (PARTITION BY post_id) AS n FROM per_post)""", ("per_post", """
SELECT post_id, domain, CAST(count(*) AS BIGINT) AS cnt
FROM (SELECT post_id, unnest(link_domains) AS domain FROM page_posts) GROUP BY post_id, domain""")),
    "csv_round_trip": query("""
SELECT query, subreddit, post_id, link, date, author, title, body,
  n_comments, up_ratio, distinguished, is_nsfw, array_to_string(external_links, ' ') AS external_links FROM posts"""),
    "comments_round_trip": query("SELECT post_id, comment_id, author, body FROM comments"),
    "description_round_trip": query("""
SELECT subreddit, CASE feature WHEN 'domain' THEN 'external_links' WHEN 'mention' THEN 'sub_mentions' WHEN 'ngram' THEN 'ngrams'
  ELSE feature END AS feature, item, cnt FROM features WHERE feature <> 'n_comments'"""),
    "saved_by_scope": query("SELECT scope, query, post_id FROM matched"),
    "saved_and_compacted": query("SELECT scope, query, post_id FROM matched"),
    "saved_collections": query("""
SELECT stored, 'forum' AS title, '2025-01-20_07_05_09' AS stamp, CAST(count(*) AS BIGINT) AS n_rows
FROM (SELECT 'posts' AS stored FROM posts UNION ALL SELECT 'description' FROM descr UNION ALL SELECT 'comments' FROM comments) GROUP BY stored"""),
    "mentions_of_all": query("""
SELECT d.subreddit, m.mention, coalesce(m.cnt, 0) AS cnt FROM descr d LEFT JOIN mention_counts m ON m.subreddit = d.subreddit"""),
    "collected_comments": query("""
SELECT DISTINCT c.* FROM comments c WHERE post_id IN (SELECT post_id FROM newest WHERE rn <= 50)"""),
    "saved_twice": query("SELECT scope, query, post_id FROM matched WHERE scope <> 'src1'"),
    "terms_by_line": query("SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS pos, p_name AS term FROM part"),
    "terms_by_word": query("""
SELECT row_number() OVER (ORDER BY p_partkey, i) - 1 AS pos, term
FROM (SELECT p_partkey, unnest(w) AS term, generate_subscripts(w, 1) AS i
  FROM (SELECT p_partkey, regexp_split_to_array(p_name, '\\s+') AS w FROM part)) WHERE term <> ''"""),
    "scope_file": query("SELECT DISTINCT source AS scope FROM documents WHERE source IS NOT NULL"),
    "author_file": query("SELECT DISTINCT author FROM posts WHERE author IS NOT NULL"),
    "search_from_file": query("""
SELECT DISTINCT 'all' AS scope, b.query, p.post_id
FROM numbered n JOIN (SELECT pos // 25 AS no, string_agg(concat('"', term, '"'), ' OR ' ORDER BY pos) AS query FROM numbered GROUP BY no) b
  ON b.no = n.pos // 25 JOIN posts p ON contains(lower(concat_ws(' ', p.title, p.body)), lower(n.term))""", ("numbered", """
SELECT row_number() OVER (ORDER BY CAST(query AS BIGINT), place) - 1 AS pos, replace(term, chr(10), ' ') AS term FROM phrases""")),
    "comments_from_dump": query("SELECT * FROM comments"),
    "broken_dump": query("""
SELECT id AS post_id, 'kept' AS state FROM raw_posts WHERE CAST(id AS BIGINT) % 7 > 1
UNION ALL SELECT id, 'set aside' FROM raw_posts WHERE CAST(id AS BIGINT) % 7 <= 1"""),
    "grown_counts": query("""
SELECT subreddit, 'post' AS kind, '' AS item, n_posts AS cnt FROM counts
UNION ALL SELECT subreddit, 'domain', domain, cnt FROM domain_totals
UNION ALL SELECT subreddit, 'mention', mention, cnt FROM mention_counts"""),
    "ngram_report": query("""
SELECT *, row_number() OVER (PARTITION BY subreddit ORDER BY cnt DESC, ngram DESC) AS rank FROM ngram_counts"""),
    "stopword_file": query("SELECT word FROM bench_words", BENCH_WORDS),
}
ORACLE["posts_from_dump"] = ORACLE["normalize_posts"]
ORACLE["reload_and_enrich"] = ORACLE["description_round_trip"]
