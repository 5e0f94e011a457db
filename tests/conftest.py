import os

import pytest

from postmine import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "postmine-tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory=os.environ.get("TEST_MEMORY", "4g"),
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make_posts(spark):
    """Posts with the stored columns from (post_id, subreddit, title, body) and overrides."""
    from postmine.operators.normalize import normalize_posts
    from postmine.schemas import RAW_POST

    def make(rows, **columns):
        raw = []
        for i, (post_id, sub, title, body, *rest) in enumerate(rows):
            values = dict(zip(("author", "created_utc", "score"), rest))
            raw.append((
                post_id, sub, title, body, values.get("author", "ann"), False, 1, 0.5, None,
                float(values.get("created_utc", 1_700_000_000 + i)), f"/r/{sub}/{post_id}", values.get("score", i),
            ))
        return normalize_posts(spark.createDataFrame(raw, RAW_POST), **columns)

    return make
