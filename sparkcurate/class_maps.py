"""Folder -> class maps of the two public leaf-photo collections the six-class task is built from."""

# --- fixed values -----------------------------------------------------------------------------

PLANTVILLAGE = {
    "Apple___healthy": "saudavel",
    "Blueberry___healthy": "saudavel",
    "Cherry_(including_sour)___healthy": "saudavel",
    "Corn_(maize)___healthy": "saudavel",
    "Grape___healthy": "saudavel",
    "Peach___healthy": "saudavel",
    "Pepper,_bell___healthy": "saudavel",
    "Potato___healthy": "saudavel",
    "Raspberry___healthy": "saudavel",
    "Soybean___healthy": "saudavel",
    "Strawberry___healthy": "saudavel",
    "Tomato___healthy": "saudavel",
    "Cherry_(including_sour)___Powdery_mildew": "oidio",
    "Squash___Powdery_mildew": "oidio",
    "Tomato___Leaf_Mold": "oidio",
    "Tomato___Septoria_leaf_spot": "oidio",
    "Grape___Black_rot": "mildio",
    "Grape___Esca_(Black_Measles)": "mildio",
    "Grape___Leaf_blight_(Isariopsis_Leaf_Spot)": "mildio",
    "Tomato___Late_blight": "mildio",
    "Potato___Late_blight": "mildio",
    "Strawberry___Leaf_scorch": "mildio",
    "Tomato___Spider_mites Two-spotted_spider_mite": "danos_pragas",
    "Apple___Apple_scab": "danos_pragas",
    "Apple___Cedar_apple_rust": "danos_pragas",
    "Peach___Bacterial_spot": "danos_pragas",
    "Pepper,_bell___Bacterial_spot": "danos_pragas",
    "Tomato___Bacterial_spot": "danos_pragas",
    "Tomato___Target_Spot": "danos_pragas",
    "Tomato___Tomato_mosaic_virus": "danos_pragas",
    "Tomato___Tomato_Yellow_Leaf_Curl_Virus": "clorose_nitrogenio",
    "Orange___Haunglongbing_(Citrus_greening)": "clorose_nitrogenio",
    "Corn_(maize)___Cercospora_leaf_spot Gray_leaf_spot": "clorose_nitrogenio",
    "Potato___Early_blight": "estresse_hidrico",
    "Tomato___Early_blight": "estresse_hidrico",
    "Apple___Black_rot": "estresse_hidrico",
    "Corn_(maize)___Northern_Leaf_Blight": "estresse_hidrico",
    "Corn_(maize)___Common_rust_": "estresse_hidrico",
}

PLANTDOC = {
    "Apple leaf": "saudavel",
    "Bell_pepper leaf": "saudavel",
    "Blueberry leaf": "saudavel",
    "Cherry leaf": "saudavel",
    "grape leaf": "saudavel",
    "Peach leaf": "saudavel",
    "Potato leaf": "saudavel",
    "Raspberry leaf": "saudavel",
    "Soybean leaf": "saudavel",
    "Strawberry leaf": "saudavel",
    "Tomato leaf": "saudavel",
    "Squash Powdery mildew leaf": "oidio",
    "grape leaf black rot": "mildio",
    "Potato leaf late blight": "mildio",
    "Tomato leaf late blight": "mildio",
    "Tomato leaf yellow virus": "clorose_nitrogenio",
    "Tomato leaf mosaic virus": "clorose_nitrogenio",
    "Apple Scab Leaf": "danos_pragas",
    "Apple rust leaf": "danos_pragas",
    "Bell_pepper leaf spot": "danos_pragas",
    "Corn Gray leaf spot": "danos_pragas",
    "Corn leaf blight": "danos_pragas",
    "Corn rust leaf": "danos_pragas",
    "Tomato leaf bacterial spot": "danos_pragas",
    "Tomato Septoria leaf spot": "danos_pragas",
    "Tomato two spotted spider mites leaf": "danos_pragas",
    "Tomato mold leaf": "danos_pragas",
    "Potato leaf early blight": "estresse_hidrico",
    "Tomato Early blight leaf": "estresse_hidrico",
}
# --- end of fixed values ----------------------------------------------------------------------
