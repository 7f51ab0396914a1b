"""Operations for building training corpora: language, quality, toxicity, duplicates, mixing, packing, output."""
