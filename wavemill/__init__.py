"""PySpark library for signal, embedding, transcript and corpus analytics."""
