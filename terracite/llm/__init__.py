"""Operators on training corpora: licences, shards, near copies, quality, languages, personal data, packing, audio and mixing."""
