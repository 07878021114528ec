"""Rules as data: the model, its analysis and rewriting, and the compiler to DataFrames."""
