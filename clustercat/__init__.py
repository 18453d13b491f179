"""Find and describe dense groups in large measurement catalogues, on Spark."""
