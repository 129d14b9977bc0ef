from tracewright.operators.diff import diff_copies, unequal_cells, _sides, FIX_FIELDS

SCHEMA = "seq long, id string, issue string, resolution string, error_excerpt string, tags string, notes string, created_at string, updated_at string, author string, author_email string, is_private boolean, extra string"


def row(seq, id_, **kw):
    base = dict(issue="i", resolution="r", error_excerpt="e", tags="a,b", notes=None, created_at="2024-01-01T00:00:00Z", updated_at="2024-01-02T00:00:00Z", author="x", author_email="x@y.z", is_private=False, extra="l")
    base |= kw
    return (seq, id_, *[base[c] for c in ("issue", "resolution", "error_excerpt", "tags", "notes", "created_at", "updated_at", "author", "author_email", "is_private", "extra")])


def diff(spark, left, right):
    return sorted(tuple(r) for r in diff_copies(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)).collect())


def test_spellings_are_equal(spark):
    left = [row(1, "A1", issue="a\r\nb ", notes=" ", tags="X;y", is_private=None)]
    right = [row(7, " a1 ", issue="a\nb", notes=None, tags='["y","x"]', created_at="2023-12-31 19:00:00-05:00", updated_at="2024-01-02T00:00:00", is_private=False, extra="r")]
    assert diff(spark, left, right) == []


def test_differences_and_missing(spark):
    left = [row(1, "a"), row(2, "b"), row(3, "c", issue="old", updated_at="2024-01-01T00:00:00Z"), row(4, "c", issue="new", updated_at="2024-02-01T00:00:00Z")]
    right = [row(1, "a", notes="n", is_private=True), row(2, "d"), row(3, "c", issue="new", updated_at="2024-02-01T00:00:00+00:00")]
    assert diff(spark, left, right) == [("a", "both_modified", "is_private"), ("a", "both_modified", "notes"), ("b", "remote_deleted", "id"), ("d", "local_deleted", "id")]


def test_latest_version_counts_even_if_stored_early(spark):
    left = [row(1, "a", issue="new", updated_at="2025-01-01T00:00:00Z"), row(2, "a", issue="old")]
    assert diff(spark, left, [row(1, "a", issue="new", updated_at="2025-01-01T00:00:00Z")]) == []


def test_empty_and_repeated(spark):
    assert diff(spark, [], []) == []
    assert diff(spark, [row(1, "a")] * 3, [row(2, "a")]) == []
    assert diff(spark, [row(1, "a", updated_at=None)], []) == [("a", "remote_deleted", "id")]


def test_matrix_points_at_unequal_cells_only(spark):
    left = spark.createDataFrame([row(i, f"k{i}") for i in range(300)], SCHEMA)
    right = spark.createDataFrame([row(i, f"k{i}", notes="changed" if i == 17 else None) for i in range(300)], SCHEMA)
    cells = unequal_cells(_sides(left, right, FIX_FIELDS, 64), len(FIX_FIELDS)).collect()
    assert len(cells) == 1
    assert cells[0]["mask"] == 1 << [f.name for f in FIX_FIELDS].index("notes")


def test_hot_key(spark):
    left = [row(i, "hot", issue=f"v{i}", updated_at=f"2024-01-01T00:00:{i % 60:02d}Z") for i in range(60)]
    assert diff(spark, left, [row(0, "hot", issue="v59", updated_at="2024-01-01T00:00:59Z")]) == []
