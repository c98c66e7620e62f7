"""Word lists, keyword rules and constants whose values decide results. Order matters where rules are tried in turn."""

from __future__ import annotations

#: Domain keywords, tried in this order.
DOMAIN_RULES: list[tuple[str, str]] = [
    ("computer_vision", "computer_vision"),
    ("computer-vision", "computer_vision"),
    ("image", "computer_vision"),
    ("vision", "computer_vision"),
    ("cv", "computer_vision"),
    ("nlp", "nlp"),
    ("natural_language", "nlp"),
    ("natural-language", "nlp"),
    ("text", "nlp"),
    ("language", "nlp"),
    ("time_series", "time_series"),
    ("time-series", "time_series"),
    ("timeseries", "time_series"),
    ("temporal", "time_series"),
    ("audio", "audio"),
    ("speech", "audio"),
    ("sound", "audio"),
    ("multimodal", "multimodal"),
    ("multi_modal", "multimodal"),
    ("multi-modal", "multimodal"),
    ("geospatial", "geospatial"),
    ("geo", "geospatial"),
    ("spatial", "geospatial"),
    ("map", "geospatial"),
    ("medical", "medical"),
    ("health", "medical"),
    ("clinical", "medical"),
    ("biomedical", "medical"),
    ("finance", "finance"),
    ("financial", "finance"),
    ("stock", "finance"),
    ("economic", "finance"),
    ("scientific", "scientific"),
    ("science", "scientific"),
    ("research", "scientific"),
    ("social", "social"),
    ("tabular", "tabular"),
    ("structured", "tabular"),
    ("classification", "tabular"),
    ("regression", "tabular"),
]

#: Format keywords, tried in this order.
FORMAT_RULES: list[tuple[str, str]] = [
    ("csv", "csv"),
    ("json", "json"),
    ("jsonl", "jsonl"),
    ("ndjson", "jsonl"),
    ("parquet", "parquet"),
    ("arrow", "arrow"),
    ("feather", "arrow"),
    ("image", "images"),
    ("png", "images"),
    ("jpg", "images"),
    ("jpeg", "images"),
    ("audio", "audio_files"),
    ("mp3", "audio_files"),
    ("wav", "audio_files"),
    ("video", "video"),
    ("mp4", "video"),
    ("hdf5", "hdf5"),
    ("h5", "hdf5"),
    ("sqlite", "sqlite"),
    ("db", "sqlite"),
    ("arff", "arff"),
    ("xlsx", "xlsx"),
    ("excel", "xlsx"),
    ("xml", "xml"),
    ("txt", "text"),
    ("text", "text"),
]

#: License keywords, tried in this order.
LICENSE_RULES: list[tuple[str, str]] = [
    ("cc0", "cc0"),
    ("cc-0", "cc0"),
    ("public domain", "cc0"),
    ("cc by-nc-sa", "cc_by_nc_sa"),
    ("cc-by-nc-sa", "cc_by_nc_sa"),
    ("cc by-nc", "cc_by_nc"),
    ("cc-by-nc", "cc_by_nc"),
    ("cc by-nd", "cc_by_nd"),
    ("cc-by-nd", "cc_by_nd"),
    ("cc by-sa", "cc_by_sa"),
    ("cc-by-sa", "cc_by_sa"),
    ("cc by", "cc_by"),
    ("cc-by", "cc_by"),
    ("mit", "mit"),
    ("apache 2", "apache_2"),
    ("apache-2", "apache_2"),
    ("apache2", "apache_2"),
    ("gpl-3", "gpl_3"),
    ("gpl3", "gpl_3"),
    ("gpl-2", "gpl_2"),
    ("gpl2", "gpl_2"),
    ("lgpl", "lgpl"),
    ("bsd", "bsd"),
    ("proprietary", "proprietary"),
    ("all rights", "proprietary"),
    ("commercial", "proprietary"),
]

#: Task keywords of catalog records, tried in this order.
TASK_RULES: list[tuple[str, str]] = [
    ("image_classification", "image_classification"),
    ("image-classification", "image_classification"),
    ("img-clf", "image_classification"),
    ("object_detection", "object_detection"),
    ("object-detection", "object_detection"),
    ("detection", "object_detection"),
    ("segmentation", "semantic_segmentation"),
    ("semantic_segmentation", "semantic_segmentation"),
    ("instance_segmentation", "instance_segmentation"),
    ("image_generation", "image_generation"),
    ("image-generation", "image_generation"),
    ("image_captioning", "image_captioning"),
    ("named_entity", "ner"),
    ("ner", "ner"),
    ("sentiment", "sentiment_analysis"),
    ("text_classification", "text_classification"),
    ("text-classification", "text_classification"),
    ("translation", "machine_translation"),
    ("machine_translation", "machine_translation"),
    ("summarization", "summarization"),
    ("summarisation", "summarization"),
    ("question_answering", "question_answering"),
    ("question-answering", "question_answering"),
    ("qa", "question_answering"),
    ("text_generation", "text_generation"),
    ("text-generation", "text_generation"),
    ("language_modeling", "language_modeling"),
    ("language_model", "language_modeling"),
    ("time_series_forecasting", "time_series_forecasting"),
    ("time-series-forecasting", "time_series_forecasting"),
    ("forecasting", "time_series_forecasting"),
    ("anomaly_detection", "anomaly_detection"),
    ("anomaly-detection", "anomaly_detection"),
    ("anomaly", "anomaly_detection"),
    ("clustering", "clustering"),
    ("recommendation", "recommendation"),
    ("speech_recognition", "speech_recognition"),
    ("speech-recognition", "speech_recognition"),
    ("asr", "speech_recognition"),
    ("audio_classification", "audio_classification"),
    ("visual_question_answering", "visual_question_answering"),
    ("vqa", "visual_question_answering"),
    ("document_understanding", "document_understanding"),
    ("binary_classification", "binary_classification"),
    ("multi_label", "multi_label_classification"),
    ("regression", "regression"),
    ("classification", "classification"),
]

#: Modality keywords of catalog records, tried in this order.
MODALITY_RULES: list[tuple[str, str]] = [
    ("text", "text"),
    ("nlp", "text"),
    ("image", "image"),
    ("vision", "image"),
    ("audio", "audio"),
    ("speech", "audio"),
    ("video", "video"),
    ("tabular", "tabular"),
    ("structured", "tabular"),
    ("table", "tabular"),
    ("time_series", "time_series"),
    ("timeseries", "time_series"),
    ("graph", "graph"),
    ("network", "graph"),
    ("multimodal", "multimodal"),
    ("multi-modal", "multimodal"),
]

#: Task keywords of queries, tried in this order.
QUERY_TASK_RULES: list[tuple[str, str]] = [
    ("instance_segmentation", "instance_segmentation"),
    ("semantic_segmentation", "semantic_segmentation"),
    ("image_caption", "image_captioning"),
    ("image_generation", "image_generation"),
    ("image_classification", "image_classification"),
    ("image-classification", "image_classification"),
    ("object_detection", "object_detection"),
    ("object-detection", "object_detection"),
    ("depth_estimation", "depth_estimation"),
    ("pose_estimation", "pose_estimation"),
    ("detection", "object_detection"),
    ("segmentation", "semantic_segmentation"),
    ("named_entity", "ner"),
    ("ner", "ner"),
    ("sentiment", "sentiment_analysis"),
    ("text_classification", "text_classification"),
    ("machine_translation", "machine_translation"),
    ("translation", "machine_translation"),
    ("summarization", "summarization"),
    ("summarisation", "summarization"),
    ("question_answering", "question_answering"),
    ("question-answering", "question_answering"),
    ("text_generation", "text_generation"),
    ("text-generation", "text_generation"),
    ("language_modeling", "language_modeling"),
    ("language-modeling", "language_modeling"),
    ("time_series_forecasting", "time_series_forecasting"),
    ("time-series-forecasting", "time_series_forecasting"),
    ("forecasting", "time_series_forecasting"),
    ("anomaly_detection", "anomaly_detection"),
    ("anomaly", "anomaly_detection"),
    ("multi_label", "multi_label_classification"),
    ("binary_classification", "binary_classification"),
    ("image", "image_classification"),
    ("regression", "regression"),
    ("classification", "classification"),
    ("clustering", "clustering"),
    ("recommendation", "recommendation"),
    ("speech", "speech_recognition"),
    ("asr", "speech_recognition"),
    ("visual_question", "visual_question_answering"),
    ("vqa", "visual_question_answering"),
    ("document", "document_understanding"),
]

#: Modality keywords of queries, tried in this order.
QUERY_MODALITY_RULES: list[tuple[str, str]] = [
    ("time_series", "time_series"),
    ("timeseries", "time_series"),
    ("multimodal", "multimodal"),
    ("multi-modal", "multimodal"),
    ("tabular", "tabular"),
    ("structured", "tabular"),
    ("image", "image"),
    ("vision", "image"),
    ("text", "text"),
    ("nlp", "text"),
    ("audio", "audio"),
    ("speech", "audio"),
    ("video", "video"),
    ("graph", "graph"),
    ("network", "graph"),
]

#: Tokens that point to a task, with weights; a token listed twice counts twice.
TASK_SIGNALS: list[tuple[str, str, float]] = [
    ("image_classification", "image_classification", 1.0),
    ("instance_segmentation", "instance_segmentation", 1.0),
    ("semantic_segmentation", "semantic_segmentation", 1.0),
    ("object_detection", "object_detection", 1.0),
    ("image_generation", "image_generation", 1.0),
    ("image_captioning", "image_captioning", 0.95),
    ("depth_estimation", "depth_estimation", 0.95),
    ("pose_estimation", "pose_estimation", 0.95),
    ("yolo", "object_detection", 0.95),
    ("coco", "object_detection", 0.8),
    ("pascal_voc", "object_detection", 0.8),
    ("bounding_box", "object_detection", 0.85),
    ("bounding_boxes", "object_detection", 0.85),
    ("detect", "object_detection", 0.7),
    ("detection", "object_detection", 0.75),
    ("segmentation", "semantic_segmentation", 0.75),
    ("caption", "image_captioning", 0.7),
    ("captioning", "image_captioning", 0.8),
    ("generate_image", "image_generation", 0.9),
    ("image", "image_classification", 0.5),
    ("crop_disease", "image_classification", 0.95),
    ("plant_disease", "image_classification", 0.95),
    ("leaf_disease", "image_classification", 0.9),
    ("plant_pathology", "image_classification", 0.9),
    ("disease_detector", "image_classification", 0.9),
    ("disease_detection", "image_classification", 0.85),
    ("disease_classification", "image_classification", 0.85),
    ("pest_detection", "image_classification", 0.85),
    ("crop_detection", "image_classification", 0.8),
    ("leaf_classification", "image_classification", 0.8),
    ("weed_detection", "image_classification", 0.8),
    ("plant_identification", "image_classification", 0.8),
    ("plantvillage", "image_classification", 0.9),
    ("plant_village", "image_classification", 0.9),
    ("diabetes", "binary_classification", 0.95),
    ("diabetes_prediction", "binary_classification", 1.0),
    ("glucose", "binary_classification", 0.8),
    ("clinical", "binary_classification", 0.65),
    ("clinical_tabular", "binary_classification", 0.9),
    ("patient_records", "binary_classification", 0.9),
    ("patient", "binary_classification", 0.6),
    ("ehr", "binary_classification", 0.9),
    ("electronic_health", "binary_classification", 0.9),
    ("medical_records", "binary_classification", 0.9),
    ("heart_disease", "binary_classification", 0.95),
    ("heart_failure", "binary_classification", 0.95),
    ("stroke", "binary_classification", 0.8),
    ("hypertension", "binary_classification", 0.85),
    ("covid", "binary_classification", 0.8),
    ("covid19", "binary_classification", 0.85),
    ("pima", "binary_classification", 0.9),
    ("mortality", "binary_classification", 0.8),
    ("survival", "binary_classification", 0.75),
    ("prognosis", "binary_classification", 0.8),
    ("readmission", "binary_classification", 0.85),
    ("sepsis", "binary_classification", 0.85),
    ("alzheimer", "binary_classification", 0.85),
    ("tumor", "binary_classification", 0.8),
    ("breast_cancer", "binary_classification", 0.95),
    ("lung_cancer", "binary_classification", 0.95),
    ("house_price", "regression", 0.95),
    ("salary", "regression", 0.85),
    ("sales", "regression", 0.75),
    ("stock", "regression", 0.7),
    ("medical", "binary_classification", 0.55),
    ("tabular", "binary_classification", 0.5),
    ("records", "binary_classification", 0.45),
    ("medical_imaging", "image_classification", 0.95),
    ("chest_xray", "image_classification", 0.95),
    ("xray_classification", "image_classification", 0.95),
    ("histology", "image_classification", 0.85),
    ("skin_lesion", "image_classification", 0.9),
    ("retinal", "image_classification", 0.8),
    ("fundus", "image_classification", 0.8),
    ("dermoscopy", "image_classification", 0.85),
    ("named_entity_recognition", "ner", 1.0),
    ("ner", "ner", 1.0),
    ("sentiment_analysis", "sentiment_analysis", 1.0),
    ("text_classification", "text_classification", 1.0),
    ("machine_translation", "machine_translation", 1.0),
    ("question_answering", "question_answering", 1.0),
    ("text_generation", "text_generation", 1.0),
    ("language_modeling", "language_modeling", 1.0),
    ("summarization", "summarization", 1.0),
    ("qa", "question_answering", 0.95),
    ("translation", "machine_translation", 0.85),
    ("summarize", "summarization", 0.8),
    ("summary", "summarization", 0.7),
    ("sentiment", "sentiment_analysis", 0.85),
    ("opinion", "sentiment_analysis", 0.65),
    ("review", "sentiment_analysis", 0.55),
    ("entity", "ner", 0.65),
    ("entities", "ner", 0.65),
    ("language_model", "language_modeling", 0.9),
    ("llm", "language_modeling", 0.75),
    ("bert", "language_modeling", 0.75),
    ("gpt", "language_modeling", 0.75),
    ("transformer", "text_classification", 0.55),
    ("time_series_forecasting", "time_series_forecasting", 1.0),
    ("anomaly_detection", "anomaly_detection", 1.0),
    ("forecasting", "time_series_forecasting", 0.9),
    ("time_series", "time_series_forecasting", 0.85),
    ("forecast", "time_series_forecasting", 0.8),
    ("anomaly", "anomaly_detection", 0.8),
    ("outlier", "anomaly_detection", 0.75),
    ("intrusion", "anomaly_detection", 0.65),
    ("binary_classification", "binary_classification", 1.0),
    ("multi_label_classification", "multi_label_classification", 1.0),
    ("multi_label", "multi_label_classification", 0.9),
    ("regression", "regression", 1.0),
    ("classification", "classification", 0.9),
    ("classify", "classification", 0.8),
    ("predict", "regression", 0.65),
    ("prediction", "regression", 0.65),
    ("price", "regression", 0.6),
    ("house_price", "regression", 0.85),
    ("housing", "regression", 0.6),
    ("churn", "binary_classification", 0.75),
    ("fraud", "binary_classification", 0.75),
    ("spam", "text_classification", 0.7),
    ("disease", "image_classification", 0.6),
    ("diagnosis", "binary_classification", 0.65),
    ("cancer", "binary_classification", 0.7),
    ("detector", "image_classification", 0.55),
    ("clustering", "clustering", 1.0),
    ("cluster", "clustering", 0.85),
    ("dimensionality_reduction", "dimensionality_reduction", 1.0),
    ("pca", "dimensionality_reduction", 0.85),
    ("embedding", "dimensionality_reduction", 0.6),
    ("grouping", "clustering", 0.65),
    ("recommendation", "recommendation", 1.0),
    ("recommender", "recommendation", 0.95),
    ("collaborative_filtering", "recommendation", 0.9),
    ("rating", "recommendation", 0.65),
    ("movie", "recommendation", 0.55),
    ("speech_recognition", "speech_recognition", 1.0),
    ("audio_classification", "audio_classification", 1.0),
    ("asr", "speech_recognition", 0.95),
    ("speech", "speech_recognition", 0.75),
    ("speaker", "speech_recognition", 0.65),
    ("music", "audio_classification", 0.6),
    ("visual_question_answering", "visual_question_answering", 1.0),
    ("vqa", "visual_question_answering", 0.95),
    ("document_understanding", "document_understanding", 1.0),
    ("ocr", "document_understanding", 0.85),
    ("document", "document_understanding", 0.55),
    ("invoice", "document_understanding", 0.65),
    ("receipt", "document_understanding", 0.65),
]

#: Tokens that point to a modality, with weights.
MODALITY_SIGNALS: list[tuple[str, str, float]] = [
    ("image", "image", 0.9),
    ("images", "image", 0.9),
    ("photo", "image", 0.85),
    ("photograph", "image", 0.85),
    ("picture", "image", 0.85),
    ("visual", "image", 0.75),
    ("computer_vision", "image", 0.9),
    ("cv", "image", 0.7),
    ("crop", "image", 0.65),
    ("leaf", "image", 0.7),
    ("plant", "image", 0.65),
    ("farm", "image", 0.55),
    ("video", "video", 0.95),
    ("videos", "video", 0.95),
    ("text", "text", 0.85),
    ("nlp", "text", 0.9),
    ("language", "text", 0.7),
    ("corpus", "text", 0.85),
    ("document", "text", 0.65),
    ("review", "text", 0.6),
    ("tweet", "text", 0.75),
    ("sentence", "text", 0.7),
    ("paragraph", "text", 0.7),
    ("audio", "audio", 0.95),
    ("sound", "audio", 0.85),
    ("speech", "audio", 0.8),
    ("music", "audio", 0.75),
    ("tabular", "tabular", 0.95),
    ("clinical", "tabular", 0.8),
    ("patient", "tabular", 0.7),
    ("medical", "tabular", 0.65),
    ("diabetes", "tabular", 0.8),
    ("glucose", "tabular", 0.75),
    ("records", "tabular", 0.65),
    ("ehr", "tabular", 0.85),
    ("table", "tabular", 0.8),
    ("csv", "tabular", 0.85),
    ("structured", "tabular", 0.7),
    ("spreadsheet", "tabular", 0.8),
    ("numerical", "tabular", 0.65),
    ("time_series", "time_series", 0.95),
    ("timeseries", "time_series", 0.95),
    ("temporal", "time_series", 0.8),
    ("sequential", "time_series", 0.7),
    ("graph", "graph", 0.9),
    ("network", "graph", 0.7),
    ("node", "graph", 0.65),
    ("multimodal", "multimodal", 0.95),
    ("multi_modal", "multimodal", 0.95),
]

#: Words that carry no meaning in a query.
STOP_WORDS: list[str] = [
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "is",
    "was", "are", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "shall", "can", "need", "i", "me", "my", "we", "our", "you", "your", "it", "its",
    "this", "that", "these", "those", "not", "no", "nor", "find", "get", "want", "looking", "search", "dataset",
    "datasets", "ml", "machine", "learning", "model", "some", "any", "all", "each", "every", "other", "good", "best",
    "large", "small", "big",
]

#: Query words and what they are replaced by.
QUERY_SYNONYMS: dict[str, str] = {
    "categorize": "classify",
    "categorizing": "classify",
    "sort": "classify",
    "categorization": "classification",
    "labeling": "classification",
    "labelling": "classification",
    "label": "classification",
    "tagging": "classification",
    "sorting": "classification",
    "forecast": "forecasting",
    "forecasting": "forecasting",
    "predicting": "prediction",
    "estimating": "prediction",
    "estimate": "predict",
    "estimation": "regression",
    "detecting": "detection",
    "identify": "detection",
    "identifying": "detection",
    "locate": "detection",
    "generating": "generation",
    "synthesize": "generation",
    "synthesizing": "generation",
    "create": "generation",
    "creating": "generation",
    "segment": "segmentation",
    "segmenting": "segmentation",
    "grouping": "clustering",
    "group": "clustering",
    "cluster": "clustering",
    "picture": "image",
    "pictures": "image",
    "photo": "image",
    "photos": "image",
    "photograph": "image",
    "img": "image",
    "imgs": "image",
    "cv": "computer_vision",
    "nlp": "text",
    "textual": "text",
    "voice": "audio",
    "sound": "audio",
    "speech": "audio",
    "temporal": "time_series",
    "sequential": "time_series",
    "spreadsheet": "tabular",
    "table": "tabular",
    "csv": "tabular",
    "numerical": "tabular",
    "qa": "question_answering",
    "ner": "named_entity_recognition",
    "nlu": "text_classification",
    "asr": "speech_recognition",
    "tts": "text_generation",
    "vqa": "visual_question_answering",
    "ocr": "document_understanding",
    "rec": "recommendation",
    "reco": "recommendation",
}

#: Phrases and the terms they add to a query.
EXPANSIONS: dict[str, list[str]] = {
    "speech recognition": ["asr", "automatic speech recognition", "spoken language", "transcription", "audio"],
    "speech to text": ["asr", "speech recognition", "transcription", "audio"],
    "speech": ["asr", "speech-to-text", "spoken", "transcription", "audio"],
    "asr": ["speech recognition", "automatic speech recognition", "spoken", "audio transcription"],
    "transcription": ["speech recognition", "asr", "spoken", "audio"],
    "voice": ["speech", "audio", "spoken", "asr"],
    "hindi": ["indic", "indian language", "devanagari", "hindi nlp", "indian"],
    "gujarati": ["indic", "indian language", "gujarati nlp", "indian"],
    "tamil": ["indic", "dravidian", "south indian", "tamil nlp"],
    "marathi": ["indic", "devanagari", "indian language", "marathi nlp"],
    "bengali": ["indic", "bangla", "south asian", "bengali nlp"],
    "punjabi": ["indic", "gurmukhi", "indian language", "punjabi nlp"],
    "telugu": ["indic", "dravidian", "south indian", "telugu nlp"],
    "indic": ["multilingual", "indian language", "hindi", "low-resource"],
    "crop disease": ["plant pathology", "plant disease", "leaf disease", "agriculture", "disease classification"],
    "plant disease": ["crop disease", "plant pathology", "leaf", "agriculture", "fungal disease"],
    "plant pathology": ["crop disease", "plant disease", "leaf classification", "agriculture"],
    "agriculture": ["crop", "plant", "farming", "agri", "agricultural"],
    "leaf disease": ["plant disease", "crop disease", "plant pathology", "agriculture"],
    "medical imaging": ["radiology", "xray", "mri", "ct scan", "histology", "pathology"],
    "chest xray": ["radiology", "pneumonia", "medical imaging", "x-ray", "thorax"],
    "ecg": ["electrocardiogram", "cardiac", "heart", "arrhythmia"],
    "ehr": ["electronic health record", "clinical", "patient", "medical"],
    "cancer": ["tumor", "pathology", "medical imaging", "oncology", "histology"],
    "diabetes": ["clinical", "tabular", "patient", "glucose", "medical"],
    "object detection": ["bounding box", "yolo", "detection", "localization"],
    "image segmentation": ["segmentation", "semantic segmentation", "instance segmentation", "mask"],
    "depth estimation": ["monocular depth", "stereo", "3d reconstruction", "lidar"],
    "face recognition": ["facial", "biometric", "identity", "face detection"],
    "pothole": ["road damage", "infrastructure", "computer vision", "image classification"],
    "sentiment analysis": ["sentiment", "opinion mining", "emotion", "polarity", "review"],
    "ner": ["named entity recognition", "entity extraction", "information extraction"],
    "machine translation": ["translation", "bilingual", "parallel corpus", "multilingual"],
    "question answering": ["reading comprehension", "extractive qa", "squad", "mcq"],
    "summarization": ["abstractive", "extractive", "document summarization", "text"],
    "llm training": ["instruction tuning", "rlhf", "finetuning", "pretraining", "language model"],
    "fraud detection": ["fraud", "anomaly", "imbalanced", "financial", "transaction"],
    "churn prediction": ["churn", "customer retention", "binary classification", "customer"],
    "time series forecasting": ["forecasting", "temporal", "stock", "sequential", "prediction"],
    "anomaly detection": ["outlier", "anomaly", "intrusion detection", "fault detection"],
    "electricity": ["energy", "power", "time series", "forecasting", "demand"],
    "stock": ["financial", "time series", "market", "trading", "forecasting"],
    "audio classification": ["sound event", "environmental sound", "esc", "audio"],
    "music": ["audio", "song", "genre classification", "music information retrieval"],
    "keyword spotting": ["wake word", "speech", "audio", "asr"],
}

#: Query words and the weights of huggingface, kaggle and openml, tried in this order.
PROVIDER_WEIGHTS: list[tuple[str, float, float, float]] = [
    ("speech", 1.5, 1.2, 0.5),
    ("asr", 1.6, 1.1, 0.4),
    ("audio", 1.5, 1.2, 0.4),
    ("transcription", 1.6, 1.0, 0.3),
    ("voice", 1.5, 1.1, 0.4),
    ("text", 1.5, 1.1, 0.6),
    ("nlp", 1.6, 1.1, 0.5),
    ("language", 1.5, 1.0, 0.5),
    ("translation", 1.6, 1.0, 0.3),
    ("sentiment", 1.4, 1.3, 0.6),
    ("llm", 1.8, 0.8, 0.3),
    ("summarization", 1.6, 0.9, 0.3),
    ("hindi", 1.6, 1.3, 0.4),
    ("indic", 1.6, 1.2, 0.4),
    ("gujarati", 1.5, 1.3, 0.3),
    ("tamil", 1.5, 1.2, 0.3),
    ("multilingual", 1.5, 1.1, 0.4),
    ("image", 1.3, 1.5, 0.5),
    ("vision", 1.3, 1.5, 0.4),
    ("detection", 1.3, 1.5, 0.4),
    ("segmentation", 1.4, 1.4, 0.3),
    ("pothole", 1.1, 1.7, 0.3),
    ("leaf", 1.2, 1.6, 0.4),
    ("tabular", 0.7, 1.4, 1.6),
    ("regression", 0.6, 1.4, 1.6),
    ("classification", 0.8, 1.3, 1.5),
    ("benchmark", 1.0, 0.9, 1.8),
    ("structured", 0.6, 1.3, 1.7),
    ("forecasting", 0.8, 1.4, 1.4),
    ("agriculture", 1.0, 1.6, 0.8),
    ("plant", 1.0, 1.5, 0.7),
    ("crop", 0.9, 1.6, 0.8),
    ("medical", 1.4, 1.4, 1.0),
    ("clinical", 1.3, 1.2, 1.2),
    ("radiology", 1.3, 1.5, 0.6),
    ("diabetes", 1.0, 1.3, 1.5),
    ("cancer", 1.3, 1.4, 0.9),
]

#: Regions and the words that name them.
REGIONS: dict[str, list[str]] = {
    "india": [
        "india", "indian", "maharashtra", "punjab", "karnataka", "tamil", "bengal", "gujarat", "rajasthan", "icar",
        "iari",
    ],
    "china": ["china", "chinese", "beijing", "shanghai", "guangdong", "sichuan", "yunnan", "caas"],
    "usa": ["usa", "american", "california", "florida", "iowa", "usda", "cornell", "michigan state", "purdue"],
    "europe": ["netherlands", "germany", "france", "spain", "italy", "wageningen", "european", "eu funded"],
    "africa": ["africa", "african", "kenya", "nigeria", "ethiopia", "ghana", "tanzania", "cgiar"],
    "brazil": ["brazil", "brazilian", "embrapa", "são paulo", "minas"],
    "australia": ["australia", "australian", "csiro", "queensland"],
    "japan": ["japan", "japanese", "tokyo", "osaka", "naro"],
}

#: Query keywords and words that count as a match for them.
MATCH_SYNONYMS: dict[str, list[str]] = {
    "crop": [
        "plant", "agriculture", "farm", "agri", "vegetation", "botanical", "paddy", "maize", "wheat", "rice", "corn",
        "soybean", "cotton", "sugarcane", "potato", "tomato", "citrus", "mango", "coffee", "tea",
    ],
    "plant": [
        "crop", "vegetation", "leaf", "botanical", "flora", "foliage", "seedling", "sapling", "shrub", "tree",
        "herb",
    ],
    "leaf": ["foliage", "plant", "crop", "vegetation", "frond", "blade", "canopy", "greenery"],
    "agriculture": [
        "farming", "agri", "crop", "rural", "field", "horticulture", "plantation", "orchard", "greenhouse", "paddy",
    ],
    "farms": ["farming", "agriculture", "agri", "field", "rural", "paddy", "plantation", "ranch", "orchard"],
    "pest": ["insect", "bug", "infestation", "larvae", "aphid", "mite", "caterpillar", "worm", "borer", "locust"],
    "disease": [
        "pathology", "infection", "disorder", "blight", "rot", "fungal", "bacterial", "viral", "lesion", "spot",
        "mildew", "rust", "canker", "wilt", "scab", "smut", "mosaic", "necrosis", "symptoms", "diagnosis", "ailment",
    ],
    "pathology": ["disease", "infection", "disorder", "blight", "lesion", "diagnosis"],
    "medical": [
        "clinical", "health", "patient", "hospital", "radiology", "retinal", "skin", "cancer", "tumor", "mri",
        "xray", "ct",
    ],
    "cancer": ["tumor", "malignant", "carcinoma", "oncology", "melanoma", "lymphoma", "biopsy"],
    "skin": ["dermatology", "dermoscopy", "lesion", "rash", "acne", "melanoma", "nevus"],
    "image": [
        "photo", "picture", "visual", "cv", "vision", "photograph", "frame", "snapshot", "thumbnail", "pixel", "rgb",
    ],
    "photo": ["image", "picture", "photograph", "snapshot", "visual"],
    "vision": ["image", "visual", "cv", "photo", "picture", "optical"],
    "camera": ["image", "photo", "video", "capture", "snapshot"],
    "classification": [
        "classifier", "detection", "recognition", "labeling", "categorization", "tagging", "sorting",
        "identification",
    ],
    "detection": [
        "classifier", "recognition", "identification", "detector", "localization", "segmentation", "bounding",
    ],
    "detector": ["detection", "classifier", "classification", "recognition", "identification", "model"],
    "recognition": ["detection", "classification", "identification", "reading"],
    "segmentation": ["pixel", "mask", "semantic", "instance", "panoptic"],
    "prediction": ["forecast", "estimation", "regression", "inference"],
    "speech": ["audio", "voice", "spoken", "asr", "transcription", "acoustic"],
    "sentiment": ["opinion", "emotion", "review", "polarity", "attitude"],
    "text": ["nlp", "language", "corpus", "document", "article", "tweet"],
    "indian": ["india", "indic", "desi", "subcontinent", "hindi", "gujarat", "bharat"],
    "chinese": ["china", "mandarin", "chinese", "sino", "hong kong"],
    "dataset": ["data", "benchmark", "collection", "corpus", "database"],
    "benchmark": ["dataset", "evaluation", "standard", "challenge", "competition"],
    "quality": ["clean", "labeled", "annotated", "curated", "verified"],
    "large": ["big", "million", "thousands", "extensive", "comprehensive"],
    "pothole": [
        "road damage", "pavement", "crack", "asphalt", "road defect", "road hazard", "surface damage", "road crack",
        "road condition",
    ],
    "road": [
        "pavement", "highway", "street", "asphalt", "infrastructure", "traffic", "driving", "lane", "intersection",
    ],
    "infrastructure": ["road", "bridge", "construction", "urban", "pavement", "civil"],
    "damage": ["defect", "crack", "deterioration", "fault", "wear", "break", "pothole", "hazard", "anomaly"],
}

#: Keywords too general to match by, unless a query has no others.
GENERIC_WORDS: list[str] = [
    "image", "images", "classification", "classifier", "computer", "vision", "dataset", "datasets", "data",
    "machine", "learning", "deep", "neural", "network", "model", "detection", "detector", "training", "train",
    "test", "benchmark", "label", "labels", "annotated", "annotation",
]

#: Parts of tags that point to image.
TAG_IMAGE: list[str] = [
    "image", "images", "vision", "computer-vision", "computer_vision", "image-classification",
    "image_classification", "object-detection", "object_detection", "segmentation", "image-segmentation",
    "image-generation", "image_generation", "medical-imaging", "medical_imaging", "medical imaging",
    "remote-sensing", "satellite", "aerial", "ocr", "optical character recognition", "face-recognition",
    "face recognition", "facial", "depth-estimation", "pose-estimation", "visual-question-answering",
    "visual question answering", "image-captioning", "cnn", "convolutional", "photo", "photos", "photograph",
    "photographs", "picture", "pictures",
]

#: Parts of tags that point to tabular.
TAG_TABULAR: list[str] = [
    "tabular", "structured", "table", "csv", "excel", "spreadsheet", "regression", "classification", "time-series",
    "timeseries", "time series", "survey", "census", "financial", "finance", "health", "healthcare", "demographics",
    "economics", "economic", "sales", "marketing", "sports", "sport statistics",
]

#: Parts of tags that point to text.
TAG_TEXT: list[str] = [
    "text", "nlp", "natural-language-processing", "natural language processing", "language", "linguistics", "corpus",
    "corpora", "sentiment", "sentiment-analysis", "text-classification", "text classification",
    "named-entity-recognition", "ner", "machine-translation", "translation", "question-answering",
    "question answering", "summarization", "summarisation", "text-generation", "text generation", "language-model",
    "language model", "bert", "gpt", "transformer", "news", "articles", "tweets", "reviews", "books", "literature",
]

#: Parts of tags that point to audio.
TAG_AUDIO: list[str] = [
    "audio", "speech", "sound", "acoustic", "asr", "speech-recognition", "speech recognition", "music", "speaker",
    "audio-classification", "sound-classification", "voice",
]

#: Parts of tags that point to video.
TAG_VIDEO: list[str] = [
    "video", "videos", "movie", "movies", "action-recognition", "action recognition", "video-classification",
]

#: Patterns in a title that point to image; one listed twice counts twice.
TITLE_IMAGE: list[str] = [
    r"\bimage[s]?\b", r"\bphoto[s]?\b", r"\bpicture[s]?\b", r"\bphotograph[s]?\b", r"\bvision\b", r"\bocr\b",
    r"\bvisual\b", r"\bleaf\b", r"\bleaves\b", r"\bplant\b", r"\bflower\b", r"\bpetal\b", r"\bretina[l]?\b",
    r"\bfundus\b", r"\boct\b", r"\bx[\-_]?ray[s]?\b", r"\bdermoscop[y|ic]\b", r"\bskin\b", r"\bface[s]?\b",
    r"\bfacial\b", r"\bgesture[s]?\b", r"\bsatellite\b", r"\baerial\b", r"\bdrone[s]?\b", r"\bmicroscop[y|ic]\b",
    r"\bhistolog[y|ical]\b", r"\bpatholog[y|ical]\b", r"\bcancer\b", r"\bfruit[s]?\b", r"\bvehicle[s]?\b",
    r"\bdigit[s]?\b", r"\bmnist\b", r"\bcifar\b", r"\bimagenet\b", r"\bchest\b", r"\bmri\b", r"\bct[\s_]scan\b",
]

#: Patterns in a title that point to tabular; one listed twice counts twice.
TITLE_TABULAR: list[str] = [
    r"\bprice[s]?\b", r"\bstock[s]?\b", r"\bmarket\b", r"\bhousing\b", r"\bhouse[s]?\b", r"\breal[\s_]estate\b",
    r"\bcredit\b", r"\bloan[s]?\b", r"\bbank[ing]?\b", r"\bsale[s]?\b", r"\brevenue\b", r"\bfinancial\b",
    r"\bcensus\b", r"\bsurvey\b", r"\bpopulation\b", r"\btitanic\b", r"\bpassenger[s]?\b", r"\bweather\b",
    r"\bclimate\b", r"\bdiabetes\b", r"\bheart[\s_]disease\b", r"\bcovid\b", r"\bpandemic\b", r"\bwine\b",
    r"\biris\b",
]

#: Patterns in a title that point to text; one listed twice counts twice.
TITLE_TEXT: list[str] = [
    r"\bnews\b", r"\barticle[s]?\b", r"\breviews?\b", r"\btexts?\b", r"\btweets?\b", r"\btwitter\b",
    r"\bsocial[\s_]media\b", r"\bcorpus\b", r"\bcorpora\b", r"\bsentiment\b", r"\bopinion[s]?\b", r"\bemail[s]?\b",
    r"\bchat[s]?\b", r"\bbooks?\b", r"\bstories?\b", r"\bnlp\b", r"\blanguage\b",
]

#: Patterns in a title that point to audio; one listed twice counts twice.
TITLE_AUDIO: list[str] = [
    r"\bspeech\b", r"\baudio\b", r"\bsound[s]?\b", r"\bmusic\b", r"\bvoice[s]?\b", r"\basr\b",
]

#: Patterns in a description that point to image; one listed twice counts twice.
DESC_IMAGE: list[str] = [
    r"\bimage[s]?\b", r"\bphoto[s]?\b", r"\bphotograph[s]?\b", r"\bpicture[s]?\b", r"jpg\b", r"jpeg\b", r"png\b",
    r"tiff?\b", r"bmp\b", r"webp\b", r"\bpixel[s]?\b", r"\bresolution\b", r"\bleaf\b", r"\bleaves\b", r"\bplant\b",
    r"\bscan[s]?\b", r"\bx[\-_]?ray[s]?\b", r"\bmri\b", r"\bct[\s_]?scan[s]?\b", r"\bretina[l]?\b", r"\bskin\b",
    r"\bdermat\w*\b", r"\bcancer\b", r"\bsatellite\b", r"\baerial\b", r"\bmicroscop\w*\b", r"\bhuman pose\b",
    r"\bface[s]?\b", r"\bfacial\b", r"\bannotated\b.*\bimage\b",
]

#: Patterns in a description that point to tabular; one listed twice counts twice.
DESC_TABULAR: list[str] = [
    r"\brow[s]?\b", r"\bcolumn[s]?\b", r"\bfeature[s]?\b", r"\battribute[s]?\b", r"\brecord[s]?\b",
    r"\bsample[s]?\b", r"\bentry\b", r"\bentries\b", r"\bcsv\b", r"\barff\b", r"\btabular\b", r"\bspreadsheet\b",
    r"\bstructured\s+data\b", r"\bvariable[s]?\b", r"\binstance[s]?\b",
]

#: Patterns in a description that point to text; one listed twice counts twice.
DESC_TEXT: list[str] = [
    r"\btext\b", r"\bsentences?\b", r"\bparagraph[s]?\b", r"\bdocument[s]?\b", r"\btoken[s]?\b", r"\bword[s]?\b",
    r"\bvocabular\w*\b", r"\bcorpus\b", r"\bmonolingual\b", r"\bbilingual\b", r"\bnlp\b", r"\blanguage\b",
    r"\breviews?\b", r"\barticles?\b", r"\btexts?\b",
]

#: Patterns in a description that point to audio; one listed twice counts twice.
DESC_AUDIO: list[str] = [
    r"\baudio\b", r"\bspeech\b", r"\bsound\b", r"\bwav\b", r"\bmp3\b", r"\brecording[s]?\b", r"\butterance[s]?\b",
    r"\bmusic\b",
]

#: Tasks and the modalities that they need.
TASK_NEEDS: dict[str, list[str]] = {
    "image_classification": ["image"],
    "object_detection": ["image"],
    "semantic_segmentation": ["image"],
    "instance_segmentation": ["image"],
    "image_generation": ["image"],
    "image_captioning": ["image", "text"],
    "depth_estimation": ["image"],
    "pose_estimation": ["image"],
    "ner": ["text"],
    "sentiment_analysis": ["text"],
    "text_classification": ["text"],
    "machine_translation": ["text"],
    "summarization": ["text"],
    "question_answering": ["text"],
    "text_generation": ["text"],
    "language_modeling": ["text"],
    "relation_extraction": ["text"],
    "coreference_resolution": ["text"],
    "classification": ["tabular"],
    "binary_classification": ["tabular"],
    "multi_label_classification": ["tabular", "text"],
    "regression": ["tabular"],
    "clustering": ["tabular"],
    "dimensionality_reduction": ["tabular"],
    "recommendation": ["tabular"],
    "time_series_forecasting": ["time_series"],
    "anomaly_detection": ["time_series", "tabular"],
    "speech_recognition": ["audio"],
    "audio_classification": ["audio"],
    "visual_question_answering": ["image", "text"],
    "document_understanding": ["image", "text"],
    "other": [],
}

#: How well modalities serve tasks of queries (tasks other and unknown: 0.5 for every known modality).
TASK_SERVES: dict[str, dict[str, float]] = {
    "classification": {"tabular": 1.0, "text": 0.7, "image": 0.7},
    "binary_classification": {"tabular": 1.0, "text": 0.7, "image": 0.7},
    "multi_label_classification": {"tabular": 1.0, "text": 0.8, "image": 0.8},
    "regression": {"tabular": 1.0, "time_series": 0.8},
    "image_classification": {"image": 1.0},
    "object_detection": {"image": 1.0, "video": 0.8},
    "semantic_segmentation": {"image": 1.0},
    "instance_segmentation": {"image": 1.0},
    "image_generation": {"image": 1.0},
    "image_captioning": {"image": 1.0, "text": 0.8},
    "depth_estimation": {"image": 1.0},
    "pose_estimation": {"image": 1.0},
    "ner": {"text": 1.0},
    "sentiment_analysis": {"text": 1.0},
    "text_classification": {"text": 1.0},
    "machine_translation": {"text": 1.0},
    "summarization": {"text": 1.0},
    "question_answering": {"text": 1.0},
    "text_generation": {"text": 1.0},
    "language_modeling": {"text": 1.0},
    "time_series_forecasting": {"time_series": 1.0, "tabular": 0.8},
    "anomaly_detection": {"time_series": 1.0, "tabular": 0.8},
    "clustering": {"tabular": 1.0, "text": 0.7, "image": 0.7},
    "dimensionality_reduction": {"tabular": 1.0},
    "recommendation": {"tabular": 1.0},
    "speech_recognition": {"audio": 1.0},
    "audio_classification": {"audio": 1.0},
    "visual_question_answering": {"image": 1.0, "text": 0.9},
    "document_understanding": {"image": 1.0, "text": 0.9},
}

#: Families of tasks.
TASK_FAMILIES: dict[str, str] = {
    "ner": "nlp",
    "sentiment_analysis": "nlp",
    "text_classification": "nlp",
    "machine_translation": "nlp",
    "summarization": "nlp",
    "question_answering": "nlp",
    "text_generation": "nlp",
    "language_modeling": "nlp",
    "image_classification": "computer_vision",
    "object_detection": "computer_vision",
    "semantic_segmentation": "computer_vision",
    "instance_segmentation": "computer_vision",
    "image_generation": "computer_vision",
    "image_captioning": "computer_vision",
    "depth_estimation": "computer_vision",
    "pose_estimation": "computer_vision",
    "classification": "classification",
    "binary_classification": "classification",
    "multi_label_classification": "classification",
    "audio_classification": "classification",
    "regression": "regression",
    "time_series_forecasting": "regression",
    "anomaly_detection": "detection",
    "clustering": "unsupervised",
    "dimensionality_reduction": "unsupervised",
    "speech_recognition": "audio",
    "visual_question_answering": "multimodal",
    "document_understanding": "multimodal",
    "recommendation": "recommendation",
}

#: Queries that only refine the one before.
REFINEMENTS: list[str] = [
    "more", "show more", "i want more", "give me more", "similar", "more like this", "different", "other options",
    "show me", "find more", "next", "again", "retry",
]

#: Word stems that hint at a task when nothing was found; the first task that fits is taken.
TASK_STEMS: dict[str, list[str]] = {
    "classification": ["classif", "recognit", "detect"],
    "generation": ["generat", "caption", "synthes"],
    "segmentation": ["segmen", "mask", "pixel"],
    "translation": ["translat", "bilingual", "parallel"],
    "speech recognition": ["speech", "audio", "asr", "wav"],
    "regression": ["regress", "predict", "forecast"],
}

#: Words of a record's title, description and tags that speak for images, and for tables, where no tag does.
IMAGE_WORDS = [
    "image", "images", "photo", "photos", "photograph", "visual", "picture", "pictures", "computer-vision", "computer vision",
    "cv", "vision", "object detection", "segmentation", "cnn", "convolutional", "jpg", "jpeg", "png", "tiff", "bmp",
    "leaf", "leaves", "plant", "flower", "satellite", "aerial", "medical image", "chest xray", "mri", "retinal", "fundus",
    "microscopy", "histology", "pathology slide", "dermoscopy", "face", "facial", "emotion recognition", "gesture",
]
TABULAR_WORDS = ["csv", "tabular", "spreadsheet", "excel", "survey", "census", "sales", "financial", "stock", "price", "revenue", "transaction"]
