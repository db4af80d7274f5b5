"""Operators for preparing large text corpora: decontamination, classifiers, dedup, media, WARC, secrets, BPE."""
