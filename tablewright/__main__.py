"""``python -m tablewright FILE.csv``: what a file is, and its first rows."""

import sys

from pyspark.sql import SparkSession

from tablewright.session import TableSession, initial_path

path = initial_path(sys.argv[1:])
if path is None:
    sys.exit(__doc__)
session = TableSession(SparkSession.builder.appName("tablewright").getOrCreate())
found = session.load(path)
print(found.effective)
print(found.headers)
print(f"{session.row_count()} rows, {len(session.warnings())} warnings")
for row in session.chunk(0, 10):
    print(row)
