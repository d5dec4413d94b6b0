"""Schema of the backup document, as DDL."""

from __future__ import annotations

# Values keep their JSON kind until the rules of the source have judged them.
BACKUP = "format_version variant, hash_algorithm variant, exported_at variant, images variant, tags variant"
FORMAT_VERSION = 1
HASH_ALGORITHM = "sha1"
