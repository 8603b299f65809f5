"""SQL of names of files, for the texts of queries."""

_NAME = """CASE WHEN {0} = '' OR lower({0}) IN ('system volume information', 'xtcache') THEN '{1}' ELSE {0} END"""
_PART = "regexp_replace(regexp_replace({0}, '[\\p{{Cc}}<>:\"/\\\\|?*]', '_', 'g'), '^[.\\s\\p{{Z}}]+|[.\\s\\p{{Z}}]+$', '', 'g')"
