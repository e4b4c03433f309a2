"""Legal-text analytics on Spark: DataFrame operators for segmentation, extraction, graph, retrieval and change detection."""
