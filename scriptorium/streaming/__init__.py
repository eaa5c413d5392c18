"""Nothing is streamed: the processing that this library covers works on whole documents and tables."""
