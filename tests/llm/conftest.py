import pytest


@pytest.fixture
def books(spark):
    """Small books with every kind of gap; makes the table of the operators' own columns."""

    def make(rows, extra=None):
        schema = (
            "book_id long, title string, books_intro string, author_intro string, authors array<string>, keywords array<string>, "
            "reviews array<string>, domain_tags array<string>, embedding array<double>, key string, record long"
        )
        names = [c.split()[0] for c in schema.split(", ")]
        return spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], schema)

    return make
