"""Training-data operators: quality, dedup, decontamination, extraction, language, licences, secrets, mixing."""
