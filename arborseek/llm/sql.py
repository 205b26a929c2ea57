"""SQL that several queries share."""

# the current row of every id; equal versions with other contents don't occur in the tables
CURRENT = """
WITH cur AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY mtime DESC NULLS LAST) AS place FROM chunks WHERE id IS NOT NULL) WHERE place = 1
)"""
