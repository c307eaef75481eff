"""Operations for large training corpora, each one a module of its own."""
