"""Large-scale text-corpus operators."""
