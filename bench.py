"""Times the headline queries and prints one line of JSON."""

from __future__ import annotations

import json
import os
import time

from postmine import build_session
from suite.queries import QUERIES

HEADLINE = (
    "subreddit_counts", "description_total", "normalize_posts", "post_links", "domain_counts", "corpus_lines",
    "corpus_by_subreddit", "clean_text", "mentions", "frequent_ngrams", "keyword_windows", "add_windows",
    "keyword_bundles", "match_keywords", "match_phrase_table", "rows_per_scope", "newest_per_query", "top_of_year",
    "comments_of_posts", "comments_per_subreddit", "posts_of_authors", "remove_duplicates", "remove_copies",
    "repeat_authors", "column_widths", "collect_search", "enriched_description",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = build_session(
        "postmine-bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"),
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).groupBy().count().collect()  # Starting the session is not part of a query.
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        # Every row and column is computed; nothing is kept.
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
