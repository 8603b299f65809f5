"""All queries of the library proper and their SQL."""

from shelfspark.plans import device, files, library, more, text

QUERIES = library.QUERIES | device.QUERIES | text.QUERIES | files.QUERIES | more.QUERIES
ORACLE = library.ORACLE | device.ORACLE | text.ORACLE | files.ORACLE | more.ORACLE
